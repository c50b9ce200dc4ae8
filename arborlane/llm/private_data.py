"""Personal data: fixed forms, and contexts learned from them.

The base finds e-mail addresses, IPv4 addresses, card numbers and telephone numbers by
their form. They are the seeds of a bootstrap: the words around a seed are a lexical
pattern, and words that look like an identifier of the same kind, but miss the fixed
form, are further instances of patterns. Pattern and instance confidences are computed
in turn on the graph of both: a pattern's confidence is the share of its distinct
instances that are seeds or found already, if there are enough of these; an instance's is
that of at least one of its patterns being right. Instances above the threshold are found,
and support and induce further patterns, until a round finds nothing new; base spans stay.

Only DataFrame functions are used. The form of each kind is written so that Java's
matcher takes time in proportion to the text: a run of characters is tried from its
start only (or where the last match ended), and groups repeat possessively.

Defined cases: a null text is empty; places are code points, ends exclusive; of two added
spans that overlap both stay; repeated rows are searched each; other columns stay out of
the way; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlane.llm.common import BROADCAST_ROWS, checkpointed, let

KINDS = ("email", "ip", "card", "phone")

_LOCAL = r"A-Za-z0-9._%+-"
FORMS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_WS = r"\x20\x09-\x0D"

#: A word with a digit or an @: what an identifier without its fixed form may look like.
WORDLIKE = rf"(?<![^{_WS}])[^{_WS}0-9@]*+[0-9@][^{_WS}]*+"
#: The part of such a word that could be the identifier, by kind.
LOOKS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+",
    "ip": r"[0-9]+(?:[.:][0-9]+){2,5}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,18}",
    "phone": r"\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{3,4}",
}
#: Numbers that go on after a single separator, of which one is a space.
SPACED = r"(?<![0-9])\(?+[0-9]++\)?+(?:[\x20.-]\(?+[0-9]++\)?+|(?<=\))[0-9]++)++"
SEEDS, SURE = 3, 0.9
CHUNK = 64


def _digits(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, "0123456789", ""))


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(m, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    if kind == "card":
        return _digits(m).between(13, 19) & F.call_function("luhn_check", F.translate(m, " -", ""))
    if kind == "phone":
        return _digits(m).between(9, 15)
    return F.lit(True)


_SPAN = "array<struct<s:int,e:int,t:string,l:string,r:string>>"


def _ends(sizes: Column) -> Column:
    """Running sums of an array of ints: of chunks first, then within chunks."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    chunks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int"))
    before = F.aggregate(chunks, F.array(F.lit(0)), lambda acc, c: F.array_append(acc, F.element_at(acc, -1) + total(F.slice(sizes, c * CHUNK + 1, CHUNK))))
    return let(before, lambda b: F.transform(sizes, lambda _, i: F.get(b, F.floor(i / CHUNK).cast("int")) + total(F.slice(sizes, i - i % CHUNK + 1, i % CHUNK + 1))))


#: The last words of a gap between two matches (two whole ones and what touches the match
#: after it), and the first ones. Words are never cut.
_LAST = rf"(?:\A[{_WS}]*+|(?<=[{_WS}])(?![{_WS}]))(?:[^{_WS}]++[{_WS}]++){{0,2}}[^{_WS}]*+\z"
_FIRST = rf"\A[^{_WS}]*+[{_WS}]*+[^{_WS}]*+[{_WS}]?"


def places(text: Column, form: str) -> Column:
    """All matches of a form with their places."""

    def placed(found: Column) -> Column:
        sizes = let(F.split(text, form, -1), lambda gaps: F.transform(found, lambda m, i: F.length(m) + F.length(F.get(gaps, i))))
        return let(sizes, lambda z: let(_ends(z), lambda e: F.transform(found, lambda m, i: F.struct(
            (F.get(e, i) - F.length(m)).alias("s"), F.get(e, i).alias("e"), m.alias("t")))))

    none = F.array().cast("array<struct<s:int,e:int,t:string>>")
    return let(F.regexp_extract_all(text, F.lit(form), 0), lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found)))


def spans(text: Column, form: str, looks: str | None = None) -> Column:
    """All matches of a form (of these, those that look like something) with their places
    and the words before and after each, other matches included."""

    def placed(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            sizes = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))
            last = F.transform(gaps, lambda g: F.regexp_extract(g, _LAST, 0))
            first = F.transform(gaps, lambda g: F.regexp_extract(g, _FIRST, 0))
            near = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))
            left = lambda b, i: F.concat(*[near(x, i - k) for k in (2, 1) for x in (b, found)], near(b, i))
            right = lambda a, i: F.concat(near(a, i + 1), *[near(x, i + k + j) for k in (1, 2) for x, j in ((found, 0), (a, 1))])
            at = F.sequence(F.lit(0), F.size(found) - 1)
            at = at if looks is None else F.filter(at, lambda i: F.regexp_like(F.get(found, i), F.lit(looks)))
            return let(sizes, lambda z: let(_ends(z), lambda e: let(last, lambda b: let(first, lambda a: F.transform(at, lambda i: F.struct(
                (F.get(e, i) - F.length(F.get(found, i))).alias("s"), F.get(e, i).alias("e"), F.get(found, i).alias("t"), left(b, i).alias("l"), right(a, i).alias("r")))))))

        return let(F.split(text, form, -1), with_gaps)

    none = F.array().cast(_SPAN)
    some = (lambda found: F.size(found) == 0) if looks is None else (lambda found: ~F.exists(found, lambda m: F.regexp_like(m, F.lit(looks))))
    return let(F.regexp_extract_all(text, F.lit(form), 0), lambda found: F.when(some(found), none).otherwise(placed(found))).cast(_SPAN)


def base(text: Column) -> dict[str, Column]:
    """The base spans of each kind. Texts without a digit or @ are not searched."""
    hint = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    none = F.array().cast(_SPAN)
    number = F.regexp_like(text, F.lit("[0-9]"))

    def of(kind: str, form: str) -> Column:
        return F.when(hint.get(kind, number), F.filter(spans(text, form), lambda x: _passes(kind, x["t"]))).otherwise(none)

    return {k: of(k, form) for k, form in FORMS.items()}


def _word(c: Column) -> Column:
    """A context word as a pattern sees it."""
    return F.regexp_replace(F.lower(c), r"\A[^\p{L}\p{N}=:#]++|(?<=[\p{L}\p{N}=:#])[^\p{L}\p{N}=:#]++\z", "")


def _patterns(left: Column, right: Column) -> Column:
    """Patterns of a place: the word before, the two words before, and both sides."""
    one = _word(F.regexp_extract(left, rf"(?<![^{_WS}])([^{_WS}]++)[{_WS}]*+\z", 1))
    two = _word(F.regexp_extract(left, rf"(?<![^{_WS}])([^{_WS}]++)[{_WS}]++[^{_WS}]++[{_WS}]*+\z", 1))
    after = _word(F.regexp_extract(right, rf"\A[^{_WS}]*+[{_WS}]++([^{_WS}]++)", 1))
    made = F.array(
        F.when(one != "", F.concat(F.lit("1 "), one)),
        F.when((one != "") & (two != ""), F.concat(F.lit("2 "), two, F.lit(" "), one)),
        F.when((one != "") & (after != ""), F.concat(F.lit("3 "), one, F.lit(" _ "), after)),
    )
    return F.array_compact(made)


def _looks() -> Column:
    """What in a candidate word or number w looks like an identifier, with its place and
    the text before and after; the rest of its own word is not context."""

    def look(k: str) -> Column:
        return F.transform(places(F.col("w.t"), LOOKS[k]), lambda x: F.struct(
            F.lit(k).alias("kind"), x["t"].alias("i"), (F.col("w.s") + x["s"]).alias("s"), (F.col("w.s") + x["e"]).alias("e"),
            F.concat(F.col("w.l"), F.regexp_replace(F.substring(F.col("w.t"), F.lit(1), x["s"]), rf"(?<![^{_WS}])[^{_WS}]++\z", "")).alias("l"),
            F.concat(F.substring(F.col("w.t"), x["e"] + 1, F.length("w.t")), F.col("w.r")).alias("r")))

    return F.flatten(F.array(*[look(k) for k in KINDS]))


def _learned(found: DataFrame, looks: DataFrame) -> DataFrame:
    """(kind, instance) of the discovered identifiers. found: a row for each document with
    its base spans; looks: a row for each candidate."""
    seed = lambda k: F.transform(k, lambda x: F.struct(F.lit(k).alias("kind"), x["t"].alias("i"), x["l"].alias("l"), x["r"].alias("r")))
    seeds = F.flatten(F.array(*[seed(k) for k in KINDS]))
    seen = found.select(F.explode(seeds).alias("x")).select("x.*").select("kind", F.lower("i").alias("i"), F.explode(_patterns(F.col("l"), F.col("r"))).alias("p"))
    seen = seen.groupBy("kind", "p", "i").agg(F.count("*").alias("n")).withColumn("seed", F.lit(True))
    other = looks.filter((F.col("kind") != "card") | ~_passes("card", F.col("i"))).select("kind", F.lower("i").alias("i"), F.explode(_patterns(F.col("l"), F.col("r"))).alias("p"))
    other = other.groupBy("kind", "p", "i").agg(F.count("*").alias("n")).withColumn("seed", F.lit(False))
    graph = seen.unionByName(other).groupBy("kind", "p", "i").agg(F.max("seed").alias("seed"))
    known = graph.filter("seed").select("kind", "i").distinct().withColumn("known", F.lit(True))
    graph = checkpointed(graph.join(known, ["kind", "i"], "left").select("kind", "p", "i", F.coalesce("known", F.lit(False)).alias("seed"), F.coalesce("known", F.lit(False)).alias("sure")))
    while True:
        pattern = graph.groupBy("kind", "p").agg(F.count_if("sure").alias("n"), F.avg(F.col("sure").cast("double")).alias("conf"))
        pattern = _small(checkpointed(pattern.filter((F.col("n") >= SEEDS) & (F.col("conf") >= 0.5)).select("kind", "p", "conf")))
        score = graph.filter(~F.col("sure")).join(pattern, ["kind", "p"]).groupBy("kind", "i").agg((1 - F.exp(F.sum(F.log(1.0000001 - F.col("conf"))))).alias("score"))
        new = checkpointed(score.filter(F.col("score") >= SURE).select("kind", "i", F.lit(True).alias("new")))
        if new.isEmpty():
            return graph.filter("sure and not seed").select("kind", "i").distinct()
        graph = checkpointed(graph.join(_small(new), ["kind", "i"], "left").select("kind", "p", "i", "seed", (F.col("sure") | F.coalesce("new", F.lit(False))).alias("sure")))


def _small(rows: DataFrame) -> DataFrame:
    """Checkpointed rows, for broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def found_in(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, an array of base spans for each kind, and an array of added ones:
    structs of kind, s and e."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), t.alias("__t"))
    looks = "|".join(LOOKS[k] for k in KINDS)
    spaced = F.filter(spans(F.col("__t"), SPACED, looks), lambda x: F.contains(x["t"], F.lit(" ")))
    words = F.when(F.regexp_like("__t", F.lit("[0-9@]")), F.concat(spans(F.col("__t"), WORDLIKE, looks), spaced)).otherwise(F.array().cast(_SPAN))
    found = rows.select("doc_id", F.monotonically_increasing_id().alias("__row"), *[c.alias(k) for k, c in base(F.col("__t")).items()], words.alias("words"))
    found = checkpointed(found)
    whole = F.regexp_like("w.t", F.lit(FORMS["email"])) | F.regexp_like("w.t", F.lit(FORMS["ip"]))  # a word with a base span is no candidate
    looks = found.select("__row", F.explode("words").alias("w")).select("__row", whole.alias("whole"), F.explode(_looks()).alias("x"))
    looks = checkpointed(looks.select("__row", "whole", "x.*"))
    new = checkpointed(_learned(found, looks.filter("not whole")))
    placed = looks.select("__row", "kind", F.lower("i").alias("i"), "s", "e").join(_small(new), ["kind", "i"]).select("__row", F.struct("kind", "s", "e").alias("x"))
    added = placed.groupBy("__row").agg(F.collect_set("x").alias("added"))
    none = F.array().cast("array<struct<kind:string,s:int,e:int>>")
    out = found.drop("words").join(added, "__row", "left")
    every = F.concat(*[F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in KINDS])
    free = lambda x: ~F.exists(every, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    return out.select("doc_id", *KINDS, F.filter(F.coalesce("added", none), free).alias("added"))


def _told(kind: str, x: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string"))


def query(docs: DataFrame) -> DataFrame:
    found = found_in(docs)
    own = lambda k: F.transform(F.col(k), lambda x: _told(k, x))
    more = lambda k: F.transform(F.array_sort(F.concat(
        F.transform(F.col(k), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))),
        F.transform(F.filter("added", lambda x: x["kind"] == k), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))), lambda x: _told(k, x))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.concat(*[own(k) for k in KINDS]), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*[more(k) for k in KINDS]), ",").alias("spans"),
        F.size("added").cast("long").alias("n_added"))
