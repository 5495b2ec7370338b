"""Locators: where the translatable text of a file is. Each runs over one file's text; Spark deals out the files."""
