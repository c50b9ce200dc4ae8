"""Scalar functions on labels, paths, templates and log text, all built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A regular expression for a path pattern: * and ? stop at /, ** crosses it."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + (("\\" + pattern[i]) if pattern[i] in r".^$+{}[]()|\\" else pattern[i]), i + 1
    return f"^{out}$"


def resolve_label(label: Column, package: Column) -> Column:
    """//:x is x; //p:x stays; :x and x are in the package."""
    return (
        F.when(F.startswith(label, F.lit("//:")), F.substr(label, F.lit(4)))
        .when(F.startswith(label, F.lit("//")), label)
        .otherwise(F.concat(F.lit("//"), package, F.lit(":"), F.ltrim(label, F.lit(":"))))
    )


def label_parts(label: Column) -> tuple[Column, Column]:
    """Package and name, split at the last colon; no package without one."""
    has = F.contains(label, F.lit(":"))
    return F.when(has, F.substring_index(label, ":", -1)).otherwise(label), F.when(has, F.substr(label, F.lit(1), F.length(label) - F.length(F.substring_index(label, ":", -1)) - 1)).otherwise("")


def ancestors(path: Column) -> Column:
    """All directories above a path, the nearest last."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def human_bytes(n: Column) -> Column:
    """Whole bytes, else one decimal of the largest unit that is at least 1."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**i, F.concat(F.format_string("%.1f", n / float(1024**i)), F.lit(f" {unit}"))).otherwise(out)
    return out


def shell_quoted(arg: Column) -> Column:
    """An argument as a shell takes it back: quoted unless it has safe characters only."""
    safe = F.regexp_like(arg, F.lit(r"^[A-Za-z0-9_./=:@%+,-]+$"))
    return F.when(safe, arg).otherwise(F.concat(F.lit("'"), F.replace(arg, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def clean(text: Column) -> Column:
    """Without terminal colour codes and characters that XML does not allow."""
    return F.regexp_replace(F.regexp_replace(text, "\x1b\\[[0-9;]*[A-Za-z]", ""), "[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def clipped(text: Column, n: int) -> Column:
    more = F.concat(F.substr(text, F.lit(1), F.lit(n)), F.lit("... "), (F.length(text) - n).cast("string"), F.lit(" more"))
    return F.when(F.length(text) > n, more).otherwise(text)


def identifier(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]", "_")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def distribution_name(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[-_.]+", "_"))


def csv_quoted(text: Column) -> Column:
    needs = F.regexp_like(text, F.lit('[",\n\r]'))
    return F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def references(text: Column) -> Column:
    """Names of ${stamp.NAME} in a text, with repeats."""
    return F.regexp_extract_all(text, F.lit(r"\$\{stamp\.([A-Z_]+)\}"), 1)


def absolute_paths(text: Column) -> Column:
    """White-space separated tokens that are absolute paths."""
    return F.filter(F.split(text, r"\s+"), lambda x: F.regexp_like(x, F.lit(r"^/[A-Za-z0-9_.-]+(/[A-Za-z0-9_.-]+)*$")))


def shell_marks(text: Column) -> Column:
    return F.filter(F.array(*[F.lit(c) for c in "|&;<>*$"]), lambda c: F.contains(text, c))


def shard_ids(name: Column, total: Column) -> Column:
    """The name itself for one shard, else name#i/n for each i."""
    many = F.transform(F.sequence(F.lit(0), F.greatest(total, F.lit(1)) - 1), lambda i: F.concat(name, F.lit("#"), i.cast("string"), F.lit("/"), total.cast("string")))
    return F.when(total <= 1, F.array(name)).otherwise(many)


def duration_text(ms: Column) -> Column:
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.floor((ms % 1000) / 100).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(ms / 60_000).cast("string"), F.lit("m"), F.floor((ms % 60_000) / 1000).cast("string"), F.lit("s")))
    )


def rule_lines(text: Column) -> Column:
    """Lines without blanks and comments, trimmed."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))


def included_paths(text: Column) -> Column:
    """What follows the last ': ' of lines whose part before has no parenthesis, trimmed, with
    / for each backslash, if it has a separator."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit(": ")))
    path = lambda x: F.translate(F.trim(F.substring_index(x, ": ", -1)), "\\", "/")
    ok = lambda x: ~F.contains(F.substr(x, F.lit(1), F.length(x) - F.length(F.substring_index(x, ": ", -1))), F.lit("(")) & F.contains(path(x), F.lit("/"))
    return F.transform(F.filter(lines, ok), path)
