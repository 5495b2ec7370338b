"""PO catalogs: a lossless codec, and its use over DataFrames.

Parsing is a state machine over lines and runs in Python, a file at a time; all else is columns. Files come as rows of
(locale, path, text), from any store that Spark reads.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import po_field

# Fixed values of the format.
WRITTEN = {7: "a", 8: "b", 9: "t", 10: "n", 11: "v", 12: "f", 13: "r"}
READ = {"a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", '"': '"', "\\": "\\", "'": "'", "?": "?"}
FIELDS = ("msgctxt", "msgid", "msgid_plural", "msgstr")

ESCAPES = re.compile(r"\\([0-7]{1,3})|\\x([0-9A-Fa-f]*)|\\(.?)|([^\\]+)", re.DOTALL)
LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)"[ \t]*', re.DOTALL)
KEYWORD = re.compile(r"([A-Za-z_]+)(?:\[([0-9]+)\])?[ \t]*(.*)", re.DOTALL)


class PoError(ValueError):
    """What is wrong, and in which line of which file. ``unsupported`` if it is legal PO that this tool can't keep."""

    def __init__(self, file: str, line: int, detail: str, unsupported: bool = False) -> None:
        super().__init__(f"{file}:{line}: {detail}")
        self.file, self.line, self.detail, self.unsupported = file, line, detail, unsupported


@dataclass
class Entry:
    """One entry. ``previous`` and ``msgctxt`` distinguish absent from empty."""

    msgid: str = ""
    msgstr: list[str] = field(default_factory=list)
    msgctxt: str | None = None
    msgid_plural: str | None = None
    comments: list[tuple[str, str]] = field(default_factory=list)
    flags: list[str] = field(default_factory=list)
    previous: dict[str, str] | None = None
    obsolete: bool = False
    line: int = 0

    @property
    def is_header(self) -> bool:
        return self.msgctxt is None and self.msgid == "" and not self.obsolete


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\").replace('"', '\\"')
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: "\\" + WRITTEN.get(ord(m[0]), f"{ord(m[0]):03o}"), text)


def unescape(raw: str, file: str = "", line: int = 0) -> str:
    """Byte escapes are joined before they are decoded, and must be UTF-8."""
    out, held = [], bytearray()

    def settle() -> None:
        if held:
            try:
                out.append(held.decode())
            except UnicodeDecodeError:
                raise PoError(file, line, f"byte escape run {''.join(f'\\{b:03o}' for b in held)} is not valid UTF-8") from None
            held.clear()

    for octal, hexa, other, plain in (m.groups() for m in ESCAPES.finditer(raw)):
        if octal is not None:
            if int(octal, 8) > 255:
                raise PoError(file, line, f"octal escape \\{octal} is larger than one byte")
            held.append(int(octal, 8))
        elif hexa is not None:
            if len(hexa) < 2:
                raise PoError(file, line, "hex escape needs exactly two hexadecimal digits")
            if len(hexa) > 2:
                raise PoError(file, line, "hex escape is ambiguous: write the byte in octal instead")
            held.append(int(hexa, 16))
        else:
            settle()
            if plain is not None:
                out.append(plain)
            elif not other:
                raise PoError(file, line, "string ends with a lone backslash")
            elif other not in READ:
                raise PoError(file, line, f'unknown escape "\\{other}"')
            else:
                out.append(READ[other])
    settle()
    return "".join(out)


def _literals(text: str, file: str, line: int) -> str:
    """The raw insides of the quoted strings that ``text`` consists of."""
    at, parts, text = 0, [], text.lstrip(" \t")
    while at < len(text):
        if text[at] != '"':
            raise PoError(file, line, f"expected a quoted string, found {text[at]!r}")
        found = LITERAL.match(text, at)
        if not found:
            lone = re.fullmatch(r'"(?:[^"\\]|\\.)*\\', text[at:], re.DOTALL)
            raise PoError(file, line, "string ends with a lone backslash" if lone else "unterminated string")
        parts.append(found[1])
        at = found.end()
    if not parts:
        raise PoError(file, line, "expected a quoted string")
    return "".join(parts)


class _Parser:
    """Collects the lines of one entry at a time. A slot is a field's name, with ``#| `` in front for a previous one."""

    def __init__(self, file: str) -> None:
        self.file, self.done = file, []
        self.start(1)

    def start(self, line: int) -> None:
        self.entry, self.slots, self.last = Entry(line=line), {}, None
        self.kind: bool | None = None
        self.touched = False

    def fail(self, line: int, detail: str, unsupported: bool = False) -> PoError:
        return PoError(self.file, line, detail, unsupported)

    def text(self, slot: str) -> str | None:
        return unescape(self.slots[slot][0], self.file, self.slots[slot][1]) if slot in self.slots else None

    def has_message(self) -> bool:
        return any(not s.startswith("#| ") for s in self.slots)

    def finish(self, next_line: int) -> None:
        if self.touched:
            self.done.append(self.built())
        self.start(next_line)

    def built(self) -> Entry:
        at, e = self.entry.line, self.entry
        context, msgid = self.text("msgctxt"), self.text("msgid")
        if msgid is None:
            if not self.slots:
                raise self.fail(at, "comment block is not followed by an entry")
            raise self.fail(at, "entry is missing its msgid" if context is None else f'entry "{context}" has a msgctxt but no msgid')
        plural, single = self.text("msgid_plural"), self.text("msgstr")
        forms = sorted(int(s[7:-1]) for s in self.slots if s.startswith("msgstr["))
        if forms and single is not None:
            raise self.fail(at, "entry mixes msgstr with indexed msgstr[N]")
        if forms and plural is None:
            raise self.fail(at, "indexed msgstr[N] without msgid_plural is not supported", unsupported=True)
        if plural is not None and not forms:
            raise self.fail(at, "plural entry has no msgstr[N]")
        if gap := next((f"found msgstr[{n}] at position {i}" for i, n in enumerate(forms) if n != i), None):
            raise self.fail(at, f"plural msgstr indices must run from 0 without gaps, {gap}")
        if single is None and not forms:
            raise self.fail(at, f'entry "{msgid if context is None else context}" is truncated: it has a msgid but no msgstr line')
        previous = {f: self.text("#| " + f) for f in FIELDS[:3] if "#| " + f in self.slots}
        spelled = {int(s[7:-1]): s for s in self.slots if s.startswith("msgstr[")}
        e.msgctxt, e.msgid, e.msgid_plural, e.previous = context, msgid, plural, previous or None
        e.msgstr = [single] if single is not None else [self.text(spelled[n]) or "" for n in forms]
        e.obsolete = bool(self.kind)
        return e

    def say(self, obsolete: bool, line: int) -> None:
        if self.kind is not None and self.kind != obsolete:
            raise self.fail(line, "entry mixes obsolete (#~) and live lines")
        self.kind = obsolete

    def more(self, slot: str, text: str, line: int) -> None:
        raw, first = self.slots.get(slot, ("", line))
        self.slots[slot] = (raw + _literals(text, self.file, line), first)
        self.touched = True

    def previous(self, content: str, obsolete: bool, line: int) -> None:
        if self.has_message():
            self.finish(line)
        self.say(obsolete, line)
        content = re.sub(r"\A[ \t]", "", content)
        if content.startswith('"'):
            if self.last is None or not self.last.startswith("#| "):
                raise self.fail(line, "previous-source continuation with no preceding #| keyword")
            return self.more(self.last, content, line)
        found = KEYWORD.fullmatch(content)
        if not found or found[2] or found[1] not in FIELDS[:3]:
            raise self.fail(line, f"unexpected keyword in previous-source comment: {content!r}")
        slot = "#| " + found[1]
        if slot in self.slots:
            raise self.fail(line, f"duplicate #| {found[1]} in one entry")
        self.last = slot
        return self.more(slot, found[3], line)

    def message(self, content: str, obsolete: bool, line: int) -> None:
        if content.startswith('"'):
            if self.last is None:
                raise self.fail(line, "string continuation with no preceding keyword")
            self.say(obsolete, line)
            return self.more(self.last, content, line)
        found = KEYWORD.fullmatch(content)
        if not found:
            raise self.fail(line, f"unrecognised line: {content!r}")
        word, index, rest = found[1], found[2], found[3]
        slot = word if index is None else f"{word}[{index}]"
        if word not in FIELDS or (index is not None and word != "msgstr"):
            raise self.fail(line, f"unknown keyword {slot!r}")
        if slot in ("msgctxt", "msgid") and any(s == "msgstr" or s.startswith("msgstr[") for s in self.slots):
            self.finish(line)
        if word == "msgstr" and "msgid" not in self.slots:
            context = self.text("msgctxt")
            raise self.fail(line, "msgstr before msgid" if context is None else f'entry "{context}" has a msgctxt but no msgid')
        if slot == "msgid_plural" and "msgid" not in self.slots:
            raise self.fail(line, "msgid_plural before msgid")
        if slot == "msgctxt" and "msgid" in self.slots:
            raise self.fail(line, "msgctxt must precede msgid")
        if slot in self.slots:
            raise self.fail(line, f"duplicate {slot} in one entry")
        self.say(obsolete, line)
        self.last = slot
        return self.more(slot, rest, line)

    def read(self, text: str) -> list[Entry]:
        for number, raw in enumerate(text.removeprefix("\ufeff").split("\n"), 1):
            line = raw.removesuffix("\r").lstrip(" \t")
            if not line:
                self.finish(number + 1)
            elif line.startswith("#~|"):
                self.previous(line[3:], True, number)
            elif line.startswith("#~"):
                self.message(re.sub(r"\A[ \t]", "", line[2:]), True, number)
            elif line.startswith("#|"):
                self.previous(line[2:], False, number)
            elif line.startswith("#"):
                if self.has_message():
                    self.finish(number)
                self.touched = True
                if line.startswith("#,"):
                    self.entry.flags += [f for f in dict.fromkeys(x.strip() for x in line[2:].split(",")) if f and f not in self.entry.flags]
                else:
                    mark = line[1:2] if line[1:2] in (".", ":") and line[1:2] else ""
                    self.entry.comments.append((mark, line[1 + len(mark) :]))
            else:
                self.message(line, False, number)
        self.finish(0)
        return self.done


def parse(text: str, file: str = "<text>") -> list[Entry]:
    """The entries of a catalog, the header first. Nothing of an entry is lost; anything malformed raises ``PoError``."""
    entries = _Parser(file).read(text)
    if entries and not entries[0].is_header:
        header = next((e for e in entries if e.is_header), None)
        detail = "catalog has no header entry (msgid \"\")" if header is None else f'catalog does not start with its header entry (msgid "") — the header is at line {header.line}'
        raise PoError(file, entries[0].line, detail)
    return entries


def render(entry: Entry) -> str:
    lines = [f"#{mark}{text}" for mark, text in entry.comments]
    if entry.flags:
        lines.append("#, " + ", ".join(dict.fromkeys(entry.flags)))

    def put(prefix: str, word: str, value: str) -> None:
        parts = re.findall(r"[^\n]*\n|[^\n]+\Z", value)
        if len(parts) <= 1:
            lines.append(f'{prefix}{word} "{escape(value)}"')
        else:
            lines.extend([f'{prefix}{word} ""', *(f'{prefix}"{escape(p)}"' for p in parts)])

    for word in FIELDS[:3]:
        if entry.previous and entry.previous.get(word) is not None:
            put("#~| " if entry.obsolete else "#| ", word, entry.previous[word])
    prefix = "#~ " if entry.obsolete else ""
    if entry.msgctxt is not None:
        put(prefix, "msgctxt", entry.msgctxt)
    put(prefix, "msgid", entry.msgid)
    if entry.msgid_plural is None:
        put(prefix, "msgstr", entry.msgstr[0] if entry.msgstr else "")
    else:
        put(prefix, "msgid_plural", entry.msgid_plural)
        for n, form in enumerate(entry.msgstr):
            put(prefix, f"msgstr[{n}]", form)
    return "\n".join(lines) + "\n"


def serialize(entries: list[Entry]) -> str:
    """Header, live and obsolete entries, each part by context and msgid in UTF-16 order, a blank line between entries."""

    def key(e: Entry) -> tuple:
        code_units = lambda s: s.encode("utf-16-be", "surrogatepass")
        return (not e.is_header, e.obsolete, *((b"", b"") if e.is_header else (code_units(e.msgctxt or ""), code_units(e.msgid))))

    return "\n".join(render(e) for e in sorted(entries, key=key))


def default_header(locale: str, generator: str) -> Entry:
    """The header of a new catalog: no version and no date, so that a run changes nothing by itself."""
    fields = (f"Language: {locale}", "MIME-Version: 1.0", "Content-Type: text/plain; charset=UTF-8", "Content-Transfer-Encoding: 8bit", f"X-Generator: {generator}")
    return Entry(msgstr=["".join(f"{x}\n" for x in fields)])


def ensured_header(header: Entry, locale: str, file: str) -> Entry:
    """The header with its language set and UTF-8 declared; other fields and their order stay."""
    lines = (header.msgstr[0] if header.msgstr else "").split("\n")
    if lines[-1] == "":
        lines.pop()
    at = {line.partition(":")[0].lower(): i for i, line in reversed(list(enumerate(lines))) if ":" in line}
    if "content-type" in at:
        charset = re.search(r"charset\s*=\s*([^\s;]+)", lines[at["content-type"]], re.IGNORECASE)
        if charset and charset[1].lower() != "utf-8":
            raise PoError(file, header.line, f'catalog declares charset "{charset[1]}"; this tool reads and writes UTF-8 only')
    else:
        lines.append("Content-Type: text/plain; charset=UTF-8")
    if "language" not in at:
        lines.insert(0, f"Language: {locale}")
    elif lines[at["language"]].partition(":")[2].strip() != locale:
        lines[at["language"]] = f"Language: {locale}"
    return replace(header, msgstr=["".join(f"{x}\n" for x in lines)])


ROWS = (
    "locale string, path string, ord int, line int, obsolete boolean, comments array<struct<marker:string,text:string>>, flags array<string>, "
    "previous struct<msgctxt:string,msgid:string,msgid_plural:string>, msgctxt string, msgid string, msgid_plural string, msgstr array<string>, error string"
)


_TEXTS, _LIST = pa.string(), pa.list_(pa.string())
_KINDS = {
    "locale": _TEXTS, "path": _TEXTS, "ord": pa.int32(), "line": pa.int32(), "obsolete": pa.bool_(), "comments": pa.list_(pa.struct([("marker", _TEXTS), ("text", _TEXTS)])), "flags": _LIST,
    "previous": pa.struct([("msgctxt", _TEXTS), ("msgid", _TEXTS), ("msgid_plural", _TEXTS)]), "msgctxt": _TEXTS, "msgid": _TEXTS, "msgid_plural": _TEXTS, "msgstr": _LIST, "error": _TEXTS,
}


def read(files: DataFrame) -> DataFrame:
    """ROWS of ``files`` (locale, path, text): a file has its entries, or one row with the error that stops it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for locale, path, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    for n, e in enumerate(parse(text or "", path)):
                        comments = [{"marker": m, "text": t} for m, t in e.comments]
                        rows.append((locale, path, n, e.line, e.obsolete, comments, e.flags, e.previous or None, e.msgctxt, e.msgid, e.msgid_plural, e.msgstr, None))
                except PoError as error:
                    rows.append((locale, path, 0, error.line, False, *[None] * 7, error.detail))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _KINDS.values(), strict=True)], list(_KINDS))

    return files.select("locale", "path", "text").mapInArrow(run, ROWS)


def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries, and errors (locale, path, line, error), of what ``read`` gives."""
    return rows.filter("error is null").drop("error"), rows.filter("error is not null").select("locale", "path", "line", "error")


def parsed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``parted`` of ``read``, for one of the two; who needs both keeps what ``read`` gives."""
    return parted(read(files))


def entry_text(row: dict[str, Column] | None = None) -> Column:
    """The text of a row (obsolete, comments, flags, previous, unit_id, msgid, msgstr), as ``render`` gives it."""
    c = row or {n: F.col(n) for n in ("obsolete", "comments", "flags", "previous", "unit_id", "msgid", "msgstr")}
    line = F.lit("\n")
    comments = F.transform(c["comments"], lambda x: F.concat(F.lit("#"), x["marker"], x["text"], line))
    flags = F.when(F.size(c["flags"]) > 0, F.concat(F.lit("#, "), F.array_join(F.array_distinct(c["flags"]), ", "), line)).otherwise("")
    bar = F.when(c["obsolete"], "#~| ").otherwise("#| ")
    old = [F.coalesce(F.concat(po_field(f, c["previous"][f], bar), line), F.lit("")) for f in FIELDS[:3]]
    prefix = F.when(c["obsolete"], "#~ ").otherwise("")
    own = [F.concat(po_field(f, v, prefix), line) for f, v in (("msgctxt", c["unit_id"]), ("msgid", c["msgid"]), ("msgstr", F.coalesce(F.get(c["msgstr"], 0), F.lit(""))))]
    return F.concat(F.array_join(comments, ""), flags, *old, *own)


def serialized(entries: DataFrame, generator: str, headers: DataFrame | None = None) -> DataFrame:
    """(locale, path, text) of the catalogs. ``headers`` (locale, path, header) has their header entries' text; others
    get the default. A catalog holds one file's units; the sort inside the aggregate makes its bytes the same each time."""
    block = F.struct("obsolete", F.encode("unit_id", "UTF-16BE").alias("k"), entry_text().alias("t"))
    bodies = entries.groupBy("locale", "path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(block)), lambda b: b["t"]), "\n").alias("body"))
    fields = F.concat(F.lit('msgid ""\nmsgstr ""\n"Language: '), F.col("locale"), F.lit(f'\\n"\n"MIME-Version: 1.0\\n"\n"Content-Type: text/plain; charset=UTF-8\\n"\n"Content-Transfer-Encoding: 8bit\\n"\n"X-Generator: {generator}\\n"\n'))
    if headers is not None:
        bodies = bodies.join(headers, ["locale", "path"], "left")
        fields = F.coalesce(F.col("header"), fields)
    return bodies.select("locale", "path", F.concat(fields, F.lit("\n"), "body").alias("text"))
