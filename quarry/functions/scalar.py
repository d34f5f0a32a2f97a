"""Scalar functions over paths, references and links, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = {
    "adoc": "AsciiDoc", "asc": "AsciiDoc", "asciidoc": "AsciiDoc", "AppleScript": "applescript", "bzl": "python", "c": "c", "cc": "cpp", "coffee": "coffeescript", "cpp": "cpp", "css": "css",
    "ejs": "html", "erb": "erb", "erl": "erlang", "f": "fortran", "go": "go", "h": "c", "hs": "haskell", "html": "html", "java": "java", "js": "javascript", "jsx": "jsx", "kt": "kotlin",
    "less": "less", "lisp": "lisp", "lua": "lua", "m": "objectivec", "md": "markdown", "ml": "ocaml", "php": "php", "pl": "perl", "pp": "puppet", "proto": "protobuf", "py": "python",
    "r": "r", "rb": "ruby", "rs": "rust", "scala": "scala", "scss": "scss", "sh": "bash", "sql": "sql", "swift": "swift", "tex": "latex", "ts": "typescript", "xml": "markup", "yaml": "yaml", "yml": "yaml",
}
FILENAMES = {"BUILD": "python", "WORKSPACE": "python", "Dockerfile": "dockerfile", "Makefile": "makefile", "makefile": "makefile", "Rakefile": "ruby", "Gemfile": "ruby"}
SHEBANGS = ((r"^#!.*\bpython[0-9.]*\b", "python"), (r"^#!.*\bruby\b", "ruby"), (r"^#!.*\b(ba|z|k)?sh\b", "bash"), (r"^#!.*\bnode\b", "javascript"), (r"^#!.*\bperl\b", "perl"))
README_EXTENSIONS = ("asciidoc", "markdown", "mdown", "adoc", "text", "mkd", "rst", "txt", "asc", "md")


#: Capitals of the letters whose full mapping is more than one: the single one that they have, or themselves.
_CAPITALS = {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x10000)) if len(c.upper()) > 1}
_SPLIT_CAPITALS = re.compile(f"([{''.join(_CAPITALS)}])")


def upper(text: Column) -> Column:
    """In capitals, letter by letter, as SQL has it: of ß one letter, where Java makes two."""

    @F.arrow_udf("string")
    def capitals(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else "".join(_CAPITALS.get(y) or y.upper() for y in _SPLIT_CAPITALS.split(x)) for x in texts.to_pylist()], pa.string())

    return capitals(text)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Up to and with the last slash."""
    return F.regexp_extract(path, "^(.*/)?", 0)


def extension(path: Column) -> Column:
    """``.ext`` in small letters, or empty."""
    return F.lower(F.regexp_extract(path, r"(?i)[^/](\.[a-z.]{1,6})$", 1))


def shorten_ref(ref: Column) -> Column:
    """A revision for people: no refs/ folder, 12 digits of a hash, no origin/."""
    plain = F.regexp_replace(ref, "^refs/(tags|branches)/", "")
    return F.regexp_replace(F.when(plain.rlike("^[0-9a-f]{40}$"), F.substring(plain, 1, 12)).otherwise(plain), "^origin/", "")


def external_url(template: Column, version: Column, name: Column, path: Column, lno: Column | None = None) -> Column:
    """Fill {lno}, {version}, {name}, {basename} and {path} in that order."""
    bare = F.when(F.contains(template, F.lit("/{path}")), F.regexp_replace(path, "^/+", "")).otherwise(path)
    number = F.coalesce(lno, F.lit(1)).cast("string") if lno is not None else F.lit("1")
    steps = [("{lno}", number), ("{version}", shorten_ref(version)), ("{name}", name), ("{basename}", F.substring_index(name, "/", -1)), ("{path}", bare)]
    return reduce(lambda url, s: F.replace(url, F.lit(s[0]), s[1]), steps, template)


def internal_url(tree: Column, path: Column, lno: Column | None = None) -> Column:
    base = F.concat(F.lit("/view/"), tree, F.lit("/"), F.regexp_replace(path, "^/+", ""))
    return base if lno is None else F.concat(base, F.lit("#L"), lno.cast("string"))


def url_pattern_of(github: Column, url_pattern: Column) -> Column:
    """The link pattern of a tree: its own, or one made of its hosting name."""
    base = F.when(github.rlike("^[a-z][a-z0-9+.-]*://"), github).otherwise(F.concat(F.lit("https://github.com/"), github))
    made = F.concat(base, F.lit("/blob/{version}/{path}#L{lno}"))
    return F.when(F.coalesce(url_pattern, F.lit("")) != "", url_pattern).when(F.coalesce(github, F.lit("")) != "", made).otherwise("")


def language(path: Column, first_line: Column, extensions: dict | None = None, filenames: dict | None = None, shebangs: tuple = SHEBANGS) -> Column:
    """By file name, then extension, then the first line (null where there is no line feed)."""
    names, exts = {**FILENAMES, **(filenames or {})}, {**EXTENSIONS, **(extensions or {})}
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    by_line = reduce(lambda other, s: F.when(first_line.rlike(s[0]), s[1]).otherwise(other), reversed(shebangs), F.lit(None).cast("string"))
    ext = F.regexp_extract(basename(path), r"\.([^.]+)$", 1)
    return F.coalesce(F.try_element_at(table(names), basename(path)), F.try_element_at(table(exts), ext), by_line, F.lit(""))


def readme_extension(name: Column) -> Column:
    """Extension of a read-me file, longest first; null if it is none."""
    pattern = "(?i:readme)\\.(" + "|".join(sorted(README_EXTENSIONS, key=lambda e: (-len(e), e))) + ")"
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1))


def breadcrumbs(path: Column) -> Column:
    """Paths of all folders down to the file."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def view_url(tree: Column, path: Column, is_dir: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.concat(F.lit("/view/"), tree, F.lit("/"), path), "/+", "/"), "/$", "")
    return F.when(is_dir, F.concat(clean, F.lit("/"))).otherwise(clean)


def permalink(url: Column, commit: Column, given: Column) -> Column:
    """The url with the commit's first 16 digits, unless what was given is a prefix of it."""
    return F.when((F.length(given) > 0) & F.startswith(commit, given), url).otherwise(F.concat(url, F.lit("?commit="), F.substring(commit, 1, 16)))


def external_domain(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)


def line_range(fragment: Column) -> Column:
    """[start, end] of ``L12`` or ``L12-L20``; an end before the start is the start; null otherwise."""
    start, end = (F.regexp_extract(fragment, "^#?L(\\d+)(?:-L?(\\d+))?$", i) for i in (1, 2))
    a = F.try_to_number(start, F.lit("9999999999")).cast("int")
    b = F.when(end != "", F.try_to_number(end, F.lit("9999999999")).cast("int"))
    return F.when(start != "", F.array(a, F.greatest(a, F.coalesce(b, a))))


def tree_entry(row: Column) -> Column:
    """mode, type, id, name and whether it is a symbolic link, of a row ``mode type id<TAB>name``."""
    part = lambda i: F.regexp_extract(row, "^(\\d+) (\\w+) ([0-9a-f]+)\\t(.*)$", i)
    return F.struct(part(1).alias("mode"), part(2).alias("type"), part(3).alias("id"), part(4).alias("name"), (part(1) == "120000").alias("symlink"))


def escape_html(text: Column) -> Column:
    return reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")], text)


def version_key(version: Column) -> Column:
    """Sorts versions naturally: runs of digits by their value."""
    parts = F.regexp_extract_all(version, F.lit("(\\d+|[^\\d]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^\\d+$"), F.lpad(p, 18, "0")).otherwise(p)), "")


def split_repo_url(url: Column, repos: list[str]) -> Column:
    """repo and path of ``/view/<repo>/<path>``, the longest repository name first."""
    import re

    names = "|".join(re.sub(r"([^A-Za-z0-9_])", r"\\\1", r) for r in sorted(repos, key=lambda r: (-len(r), r)))
    pattern = f"^/(?:view/)?({names})(?:/(.*))?$" if names else "(?!)"
    return F.when(url.rlike(pattern), F.struct(F.regexp_extract(url, pattern, 1).alias("repo"), F.regexp_extract(url, pattern, 2).alias("path")))
