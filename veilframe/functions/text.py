"""Column functions on text, terms and paths. All are built-in expressions, so scans stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Maximal runs of identifier characters; and a lossless cut of a text into such runs and what is between.
RUN = "[A-Za-z0-9_]+"
LOSSLESS = "[A-Za-z0-9_]+|[^A-Za-z0-9_]+"

#: Runs that are never rewritten (a fixed value: keywords of common programming languages).
KEYWORDS = (
    "as", "async", "await", "break", "class", "const", "continue", "crate", "def", "else", "enum", "export", "extern", "false", "fn", "for", "from",
    "function", "if", "impl", "import", "in", "let", "loop", "match", "mod", "move", "mut", "pub", "ref", "return", "self", "Self", "static",
    "struct", "super", "trait", "true", "type", "unsafe", "use", "var", "where", "while",
)

#: Language labels by file extension (fixed values); other extensions are "text".
LANGUAGES = {
    "rust": ["rs"], "python": ["py"], "typescript": ["ts", "tsx"], "javascript": ["js", "jsx"], "markdown": ["md", "markdown"], "plaintext": ["txt", "rst", "adoc"],
    "toml": ["toml"], "json": ["json"], "go": ["go"], "c": ["c", "h", "cc", "cpp", "cxx", "hh", "hpp", "hxx", "m", "mm"], "shell": ["sh", "bash", "zsh"], "yaml": ["yml", "yaml"],
}


def runs(text: Column) -> Column:
    """The word runs of a text in order."""
    return F.regexp_extract_all(text, F.lit(RUN), F.lit(0))


def pieces(text: Column) -> Column:
    """Runs and the stretches between them; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(LOSSLESS), F.lit(0))


def normalize_term(term: Column) -> Column:
    """Without ``_`` and ``-``, A-Z lower-cased."""
    return F.translate(term, "ABCDEFGHIJKLMNOPQRSTUVWXYZ_-", "abcdefghijklmnopqrstuvwxyz")


def is_run(term: Column) -> Column:
    """Whether a term is one word run that keeps a letter or digit when normalised: only such terms can be matched."""
    return F.coalesce(term.rlike(f"^(?:{RUN})$") & (normalize_term(term) != ""), F.lit(False))


def adapt_case(original: Column, replacement: Column) -> Column:
    """The replacement in the casing of what it stands for; characters outside identifiers become ``_``."""
    base = F.regexp_replace(replacement, "[^A-Za-z0-9_]", "_")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    raised, lowered = F.translate(base, lower, upper), F.translate(base, upper, lower)
    letters = original.rlike("[A-Za-z]")
    return (
        F.when(letters & ~original.rlike("[a-z]"), raised)
        .when(letters & ~original.rlike("[A-Z]"), lowered)
        .when(original.rlike("^[A-Z]"), F.concat(F.substring(raised, 1, 1), F.substring(base, 2, 1 << 30)))
        .otherwise(base)
    )


def derive_alias(term: Column, salt: str) -> Column:
    """A stable alias for a term without one: ``sym_`` and 8 hex digits of a salted digest."""
    return F.concat(F.lit("sym_"), F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), term), 256), 1, 8))


def derive_stemmed_alias(term: Column, stem: Column, salt: str) -> Column:
    """A readable stem and 4 hex digits of a salted digest."""
    return F.concat(stem, F.lit("_"), F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), term), 256), 1, 4))


def term_pattern(normalized: str) -> str:
    """A regular expression for a normalised term: any casing, ``_`` between letters. Classes are written out, as
    case-insensitive matching would fold letters beyond ASCII in some dialects.
    """
    return "_*".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in normalized)


def contains_word(text: Column, word: str) -> Column:
    """Whether ``word`` stands in a text with no identifier character on either side."""
    return text.rlike(f"(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])")


def replace_word(text: Column, word: str, new: str) -> Column:
    """Replaces the runs equal to ``word``."""
    return F.array_join(F.transform(pieces(text), lambda p: F.when(p == word, F.lit(new)).otherwise(p)), "")


def count_word(text: Column, word: str) -> Column:
    return F.size(F.filter(runs(text), lambda r: r == word)).cast("long")


def identifier_tokens(value: Column) -> Column:
    """The different lower-cased parts of an identifier, sorted: cut at other characters, at aB and at ABc."""
    spaced = F.regexp_replace(F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    lowered = F.translate(spaced, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0))))


def shares_owner(candidate: Column, external: Column) -> Column:
    """Whether two names are the same (4 characters or more) or share a part of 6 characters or more."""
    same = (F.length(normalize_term(candidate)) >= 4) & (normalize_term(candidate) == normalize_term(external))
    long_parts = F.filter(identifier_tokens(candidate), lambda t: F.length(t) >= 6)
    return same | F.arrays_overlap(long_parts, identifier_tokens(external))


def valid_identifier(name: Column, ascii_only: bool = True) -> Column:
    return name.rlike("^[A-Za-z_][A-Za-z0-9_]*$" if ascii_only else r"^[\p{L}_][\p{L}\p{N}_]*$")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language_of(path: Column) -> Column:
    """Label by file name and extension; unknown ones count as code and are called ``text``."""
    name = file_name(path)
    suffix = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    found = F.when(name.isin("Dockerfile", "Makefile", "makefile"), "shell")
    for label, suffixes in LANGUAGES.items():
        found = found.when(suffix.isin(suffixes), label)
    return found.otherwise("text")


def origin_of(path: Column) -> Column:
    """vendor, dependency, generated or owned, by path components in any case."""
    parts = F.split(F.lower(F.translate(path, "\\", "/")), "/")
    among = lambda *names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    generated = among("generated", "gen") | F.lower(path).rlike(r"(\.generated|\.g)\.rs$")
    return (
        F.when(among("vendor", "vendors", "third_party", "third-party"), "vendor")
        .when(among("target", "node_modules", "deps", "_deps"), "dependency")
        .when(generated, "generated")
        .otherwise("owned")
    )


def safe_path(path: Column) -> Column:
    """A relative path without ``.`` parts; null for empty or absolute paths and those with ``..``."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    bad = path.startswith("/") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def glob_regex(pattern: str) -> tuple[str, bool]:
    """A glob as a regular expression, and whether it is for whole paths (else for file names).

    ``*`` and ``?`` stop at ``/``, ``**`` as a component crosses directories, ``[..]`` and ``{a,b}`` are as usual.
    """
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i) and (i == 0 or pattern[i - 1] == "/") and (i + 2 == len(pattern) or pattern[i + 2] == "/"):
            if i + 2 == len(pattern):
                out += ".*"
                i += 2
            else:
                out += "(?:[^/]*/)*"
                i += 3
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] in ("!", "^")))
            if end < 0:
                raise ValueError(f"a class is not closed in the glob {pattern!r}")
            body = pattern[i + 1 : end]
            negated = body[0] in "!^"
            out += f"(?!/)[{'^' if negated else ''}{body[negated:].replace(chr(92), chr(92) * 2).replace('[', chr(92) + '[').replace('&', chr(92) + '&')}]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"alternatives are not closed in the glob {pattern!r}")
    return f"^{out}$", "/" in pattern


def matches_glob(path: Column, pattern: str | None) -> Column:
    """Glob filter: without a pattern all paths, without ``/`` in it by file name at any depth, else by path."""
    if pattern is None:
        return F.lit(True)
    regex, whole = glob_regex(pattern)
    return (path if whole else file_name(path)).rlike(regex)


def lines(text: Column) -> Column:
    """Lines without their ends (``\\n`` or ``\\r\\n``); none after a final line end."""
    cut = F.split(text, "\r?\n")
    return F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)


def lines_with_ends(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[^\n]*\n|[^\n]+"), F.lit(0))


def dominant_eol(text: Column) -> Column:
    """``\\r\\n`` only if more than half of the line ends are."""
    ends, pairs = F.regexp_count(text, F.lit("\n")), F.regexp_count(text, F.lit("\r\n"))
    return F.when(pairs * 2 > ends, "\r\n").otherwise("\n")


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *parts), 256)
