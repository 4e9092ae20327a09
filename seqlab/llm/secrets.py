"""Secret scans by multipart credential linking (operator 10), with DataFrame functions only.

Base spans are found by pattern and always reported: ``assign`` (a secret-like
name, a sign and a value of 6 or more characters), ``access`` (access key ids)
and ``hex`` (24 or more hexadecimal digits).  Weak candidates, which alone are
too common to report, are ``user`` (an account name), ``secret`` (40 characters
that look like a secret key) and ``endpoint`` (a service address).  Parts are
linked by an interval join: two parts are in one scope if at most ``scope``
characters lie between them (overlapping parts always are).  A weak ``user`` or ``secret`` is reported when
its counterpart is in scope (an identifier for a secret, a secret for an
identifier, either possibly weak), an ``endpoint`` when both an identifier and
a secret are.

Offsets: the text is split by a pattern, so a match starts after the lengths
of the pieces and matches before it; lengths are in code points.  The running
sums (and those of redaction) go over blocks of about the root of the number
of matches, and then over the matches of each block, so that a text of very
many matches does not copy its spans at every one.

The interval join puts a part into the buckets of ``scope`` characters that it
covers, and a weak part also into those within reach, and joins them by document
and bucket, so a very long document spreads over many keys.  Only documents with
weak candidates enter it.  Every text is read by the patterns once: the spans are
written, and linked from there.

A null or empty text has no spans.  Equal rows get equal results, one for
each; rows that share a doc_id but not their text are told apart.  Columns
that are not kept are ignored.
"""
from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.llm.scratch import written

#: Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Patterns of the weak kinds.
USER = r"""(?i)(?:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
#: Runs in which ``secret`` values are looked for: they end at '=', '_' and '-', so a name and a sign may stand before the value.
VALUE_RUN = r"[A-Za-z0-9+/]+"
#: What such a run must be: 40 characters, among them a digit, a capital and a small letter.
SECRET_FORMS = [r"^[A-Za-z0-9+/]{40}$", "[0-9]", "[A-Z]", "[a-z]"]
ENDPOINT = r"""(?:https?|s3a?|ftp|ssh|amqps?|redis|mysql|mongodb|postgres(?:ql)?|jdbc:[a-z0-9]+)://[^\x20\x09-\x0D"'<>]+"""
KINDS = ["assign", "access", "hex", "user", "secret", "endpoint"]

_SPANS = "array<struct<start:int,kind:int,end:int>>"
#: Documents and linked spans together up to which they are broadcast (a key has 64 bytes, a span 12); beyond, a shuffled join.
BROADCAST_ITEMS = 200_000


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(text: Column, kind: int, pattern: str, cheap: Column, ok) -> Column:
    """Spans of the leftmost non-overlapping matches for which ``ok(match, group 2)`` holds; ``cheap`` rules texts out."""
    pattern_ = F.lit(pattern)
    before = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))

    def rows(whole):
        value = F.regexp_extract_all(text, pattern_, F.lit(2)) if kind == 0 else whole
        return F.arrays_zip(before.alias("gap"), F.transform(whole, lambda m: F.length(m)).alias("size"), F.zip_with(whole, value, ok).alias("ok"))

    def step(at, x):
        begin = at + x["gap"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        new = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return end, F.when(F.coalesce(x["ok"], F.lit(False)), F.array(new)).otherwise(F.array().cast(_SPANS))

    found = _running(_let(F.regexp_extract_all(text, pattern_, F.lit(0)), rows),
                     lambda at, x: at + x["gap"] + F.coalesce(x["size"], F.lit(0)), step, _SPANS)
    return F.when(cheap, found).otherwise(F.array().cast(_SPANS))


def _blocks(rows: Column) -> Column:
    """An array cut into arrays of about the root of its size."""
    def cut(r):
        size = F.ceil(F.sqrt(F.greatest(F.size(r), F.lit(1)))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(r) / size).cast("int"), F.lit(1)) - 1),
                           lambda i: F.slice(r, i * size + 1, size))

    return _let(rows, cut)


def _running(rows: Column, move, step, out: str) -> Column:
    """What ``step(at, row)`` gives for all rows in order, ``at`` being moved on by every row from 0.

    ``step`` returns (the moved ``at``, an array of type ``out``); ``move`` returns the moved ``at`` alone.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def starts(blocks):
        return F.aggregate(blocks, start, lambda acc, block: F.struct(
            F.aggregate(block, acc["at"], move).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])

    def inside(block, at):
        first = F.struct(at.alias("at"), F.array().cast(out).alias("out"))

        def one(acc, x):
            moved, new = step(acc["at"], x)
            return F.struct(moved.alias("at"), F.concat(acc["out"], new).alias("out"))

        return F.aggregate(block, first, one, lambda acc: acc["out"])

    return _let(_blocks(rows), lambda blocks: F.flatten(F.zip_with(blocks, starts(blocks), inside)))


def _longer(n: int):
    return lambda match, value: F.length(value) >= n


def base_spans(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(
        spans(t, 0, ASSIGN, t.rlike(r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""), _longer(6)),
        spans(t, 1, ACCESS, t.contains("AKIA"), _longer(20)),
        spans(t, 2, HEX, t.rlike("[0-9a-f]{24}"), _longer(24))))


def weak_spans(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(
        spans(t, 3, USER, t.rlike(USER), _longer(1)),
        spans(t, 4, VALUE_RUN, t.rlike("[A-Za-z0-9+/]{40}"), lambda match, value: reduce(
            and_, [match.rlike(form) for form in SECRET_FORMS])),
        spans(t, 5, ENDPOINT, t.contains("://"), _longer(1))))


def linked_spans(parts: DataFrame, scope: int) -> DataFrame:
    """(key, linked): the weak spans of each key that have their complementary parts in scope.

    ``parts`` holds one row for each part: key, start, kind, end.
    """
    roles = (F.when(F.col("kind").isin(1, 3), "id").when(F.col("kind").isin(0, 2, 4), "secret").otherwise("endpoint"))
    parts = parts.distinct().withColumn("role", roles)

    def buckets(low, high):
        return F.explode(F.sequence(F.floor(F.greatest(low, F.lit(0)) / scope), F.floor(high / scope))).alias("bucket")

    weak = parts.where("kind >= 3").select("*", buckets(F.col("start") - scope, F.col("end") + scope))
    near = parts.where("role <> 'endpoint'").select(
        "key", buckets(F.col("start"), F.col("end")), F.col("start").alias("from"), F.col("end").alias("to"), F.col("role").alias("other_role"))
    apart = F.greatest(F.col("from") - F.col("end"), F.col("start") - F.col("to"))
    hits = (weak.join(near, ["key", "bucket"]).where((apart <= scope) & (F.col("role") != F.col("other_role")))
            .groupBy("key", "start", "kind", "end", "role").agg(F.count_distinct("other_role").alias("roles"))
            .where("roles >= if(role = 'endpoint', 2, 1)"))
    return hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))


def find_secrets(documents: DataFrame, keep: list[str], scope: int = 200, text: str = "text") -> DataFrame:
    """The kept columns with ``base`` and ``spans``: arrays of (start, kind number, end), by start, then kind.

    Kind numbers index ``KINDS``; starts and ends are code points, ends exclusive.
    """
    out = ("base", "spans")
    keep = [c for c in keep if c not in out]
    # the kept columns travel as one struct, so their names cannot clash with those used here
    df = documents.select(F.struct(*keep).alias("row"), F.col(text).alias("t"))
    scanned = df.select("row", "t", base_spans(F.col("t")).alias("base"), weak_spans(F.col("t")).alias("weak"))
    key = F.when(F.size("weak") > 0, F.sha2(F.concat_ws("\x00", F.to_json("row"), F.col("t")), 256)).alias("key")
    found = written(scanned.select("row", "base", "weak", key), "spans")
    parts = found.where("key is not null").select("key", F.explode(F.concat("weak", "base")).alias("s")).select("key", "s.start", "s.kind", "s.end")
    linked = written(linked_spans(parts, scope), "linked")
    items = linked.agg((F.count("*") + F.coalesce(F.sum(F.size("linked")), F.lit(0))).alias("n")).first()["n"]
    side = F.broadcast(linked) if items <= BROADCAST_ITEMS else linked
    more = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(_SPANS)))).alias("spans")
    return (found.where("key is null").select("row.*", "base", F.col("base").alias("spans"))
            .unionByName(found.where("key is not null").join(side, "key", "left").select("row.*", "base", more)))


def spelled(span_list: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(span_list, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, span_list: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``mask``."""
    # spans that start before an earlier one has ended belong to its run; a run keeps (where it starts, where the one before ended)
    runs = _running(span_list, lambda at, s: F.greatest(at, s["end"]), lambda at, s: (F.greatest(at, s["end"]), F.when(
        (s["start"] < at) & (at > 0), F.array().cast("array<struct<from:int,to:int>>")).otherwise(
            F.array(F.struct(at.alias("from"), s["start"].alias("to"))))), "array<struct<from:int,to:int>>")

    def part(block):
        # a block's text is cut out once, so that its pieces are not looked up from the start of the whole text
        first, last = F.get(block, F.lit(0))["from"], F.get(block, F.size(block) - 1)["to"]
        return _let(F.substring(text, first + 1, last - first), lambda own: F.array_join(F.transform(
            block, lambda r: F.concat(F.substring(own, r["from"] - first + 1, r["to"] - r["from"]), F.lit(mask))), ""))

    ended = F.array_max(F.transform(span_list, lambda s: s["end"]))
    done = F.concat(F.array_join(F.transform(_blocks(runs), part), ""), F.substring(text, ended + 1, F.length(text)))
    return F.when(F.size(span_list) > 0, done).otherwise(text)
