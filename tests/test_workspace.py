import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.sources import globs, workspace
from tessella.sources.manifest import ManifestError, parse_manifest
from tessella.sources.workspace import Exit, WorkspaceError

MANIFEST = """apiVersion: acme/v1
locales: {targets: [de, pt-BR]}
surfaces:
  slides: {include: ["slides/**/*.md"], exclude: ["slides/draft/**"]}
  labs: {include: ["labs/*.md"]}
  quiz: {include: ["quiz/*.json"], schema: opentofu-workshop}
protectedTerms: [Pod]
lengthBudgets: {default: 1.5, cover: 1.1}
"""


def tree(root, files):
    for path, text in {".localization/workshop.yaml": MANIFEST, **files}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text, "utf-8")
    return root


def naive(pattern, path):
    """A glob as one regular expression."""
    def segment(s):
        if s == "**":
            return None
        body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in s)
        return (r"(?!\.)" if s[:1] in "*?" else "") + body

    out = ""
    parts = pattern.split("/")
    for n, s in enumerate(parts):
        last = n == len(parts) - 1
        if s == "**":
            out += r"(?:(?!\.)[^/]+(?:/(?!\.)[^/]+)*)?" if last else r"(?:(?!\.)[^/]+/)*"
        else:
            out += segment(s) + ("" if last else "/")
    return re.fullmatch(out, path) is not None or (pattern.endswith("/**") and re.fullmatch(out.removesuffix(r"(?:(?!\.)[^/]+(?:/(?!\.)[^/]+)*)?").removesuffix("/"), path) is not None)


pieces = st.lists(st.sampled_from(["a", "b", "*", "?", ".a", "a*", "*b", "a?b", "**", "*.md"]), min_size=1, max_size=4).map("/".join)
paths = st.lists(st.sampled_from(["a", "b", "ab", "aab", "axb", ".a", "x.md", "a.b"]), min_size=1, max_size=4).map("/".join)


@given(pieces, paths)
@settings(max_examples=1500, deadline=None)
def test_globs_agree_with_a_naive_matcher(pattern, path):
    assert globs.compile_glob(pattern).matches(path) == naive("/".join(s for i, s in enumerate(pattern.split("/")) if s != "**" or i == 0 or pattern.split("/")[i - 1] != "**"), path)


def test_braces_bases_and_bounds():
    glob = globs.compile_glob("{a,b/{c,d}}/x{1,2}.md")
    assert glob.matches("b/d/x2.md") and glob.matches("a/x1.md") and not glob.matches("b/x1.md")
    assert glob.bases == ["a", "b/c", "b/d"]
    for bad in ("a{", "}", "a/./b", "a//b", "../a", "{a,b}" * 7, "a/" * 33 + "b", "x" * 600):
        with pytest.raises(globs.GlobError):
            globs.compile_glob(bad)
    began = time.time()
    for _ in range(50):
        assert not globs.compile_glob("*a" * 8 + "*b").matches("a" * 60)
        assert not globs.compile_glob("/".join(["**", "*"] * 15) + "/z").matches("/".join("a" * 40))
    assert time.time() - began < 5


def test_manifest():
    found = parse_manifest(MANIFEST)
    assert (found.group, found.source, found.targets, found.quiz_schema) == ("acme", "en", ("de", "pt-BR"), "opentofu-workshop")
    assert found.budget_for() == 1.5 and found.budget_for("cover") == 1.1 and found.budget_for("toString") == 1.5


@pytest.mark.parametrize(
    ("text", "codes"),
    [
        ("[", ["malformed-yaml"]), ("- a", ["invalid"]), ("a: 1", ["missing"]), ("apiVersion: acme/v2\nx: 1", ["unsupported-api-version"]), ("apiVersion: acme/v1", ["missing", "missing"]),
        (MANIFEST + "extra: 1\n", ["unknown-key"]), (MANIFEST.replace("[de, pt-BR]", "[de, DE, en, no_, yes]"), ["duplicate", "invalid", "invalid"]), (MANIFEST.replace("labs/*.md", "/labs"), ["invalid"]),
        (MANIFEST.replace("opentofu-workshop", "x"), ["invalid"]), (MANIFEST.replace("1.5", "-1"), ["invalid"]), (MANIFEST.replace("[Pod]", "[Pod, Pod, '']"), ["duplicate", "invalid"]), (MANIFEST.replace("labs:", "docs:"), ["unknown-key"]),
    ],
)
def test_manifest_issues(text, codes):
    with pytest.raises(ManifestError) as error:
        parse_manifest(text)
    assert [i.code for i in error.value.issues] == codes


def test_discovery(tmp_path):
    root = tree(tmp_path, {"slides/a.md": "", "slides/_b.md": "", "slides/.c.md": "", "slides/draft/d.md": "", "slides/node_modules/e.md": "", "labs/f.md": "", "labs/sub/g.md": ""})
    (root / "slides/link.md").symlink_to(root / "labs/f.md")
    files, warnings = workspace.discover(workspace.load(root))
    assert [(f.surface, f.path, f.base) for f in files] == [("slides", "slides/_b.md", "slides"), ("slides", "slides/a.md", "slides"), ("labs", "labs/f.md", "labs")]
    assert warnings == ['nothing matches surfaces.quiz.include[0] ("quiz/*.json")', "the symlink slides/link.md was left alone"]


def test_refusals(tmp_path):
    with pytest.raises(WorkspaceError) as error:
        workspace.load(tmp_path / "none")
    assert error.value.code == Exit.NO_INPUT
    root = tree(tmp_path / "w", {"labs/bad.md": ""})
    (root / "labs/bad.md").write_bytes(b"\xff")
    with pytest.raises(WorkspaceError, match="not valid UTF-8"):
        workspace.read_sources(workspace.load(root))
    for path in ("", "/a", "a/../b", "a\\b", "a//b", "a\x00"):
        with pytest.raises(WorkspaceError):
            workspace.inside(root, path)
    (root / "i18n").symlink_to(tmp_path)
    with pytest.raises(WorkspaceError, match="symlink"):
        workspace.write_all(workspace.load(root), [("i18n/de/a.po", "x")])
    (root / ".localization/workshop.yaml").write_text(MANIFEST.replace("labs/*.md", "slides/*.md"))
    (root / "slides").mkdir()
    (root / "slides/a.md").write_text("")
    with pytest.raises(WorkspaceError, match="claimed by both"):
        workspace.discover(workspace.load(root))
    (root / ".localization/workshop.yaml").write_text(MANIFEST.replace("labs/*.md", "i18n/*.md"))
    with pytest.raises(WorkspaceError, match="reaches into"):
        workspace.discover(workspace.load(root))
