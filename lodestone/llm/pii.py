"""Personal data: patterns with checks, and terms that give a protected entity away. DataFrame functions only.

Patterns find e-mail addresses, network addresses, card and phone numbers; each distinct value is a protected entity.
How strongly a term reveals an entity is estimated from the whole corpus: with P(c) the entity's occurrences for each
document and P(c|t) the share of all occurrences of t that stand within ``REACH`` characters of c, the term's pointwise
mutual information log P(c|t)/P(c) is compared with the entity's information -log P(c). A term that reaches the share
``DISCLOSURE`` of it and was seen ``SUPPORT`` times beside c gives c away wherever it stands: each of its places in any
document is a span, unless a base span overlaps it, and is generalised. A term may give several entities away.

Running sums over a text's matches go block by block, and pieces of a text are taken from blocks of it, so the work on
one text grows in proportion to its length.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut

KINDS = ["email", "ip", "card", "phone", "term"]
REACH, DISCLOSURE, SUPPORT = 60, 0.8, 3
#: Terms up to which the candidates are sent to every executor before the corpus is counted, and documents up to which those
#: that hold telling terms, and bytes of these terms, are sent to where the texts are; more are joined by a shuffle.
BROADCAST_TERMS, BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 200_000, 32_000_000

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# The patterns' matches, written so that long runs take time in proportion: a match can begin only where its first run
# does or where the match before ended, and runs that can't be given back are possessive.
PATTERNS = {
    "email": rf"(?={_LOCAL})(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TERM = r"\p{L}{3,}+"


#: Elements of one block of a running sum, and characters of one block of a text.
_BLOCK, _CHARS = 128, 256


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, combine, zero: int) -> Column:
    """array<int>: each element combined with all before it."""

    def fold(part: Column) -> Column:
        return F.aggregate(part, F.lit(zero), combine)

    def whole(v: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int"))
        totals = F.transform(at, lambda k: fold(F.slice(v, k * _BLOCK + 1, _BLOCK)))
        before = lambda t: F.transform(at, lambda k: fold(F.slice(t, F.lit(1), k)))
        inside = lambda part, ahead: F.transform(part, lambda x, i: combine(combine(ahead, fold(F.slice(part, F.lit(1), i))), x))
        return _let(_let(totals, before), lambda ahead: F.flatten(F.transform(at, lambda k: _let(F.slice(v, k * _BLOCK + 1, _BLOCK), lambda part: inside(part, F.get(ahead, k))))))

    return _let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<int>")))


def _add(a: Column, b: Column) -> Column:
    return a + b


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def located(text: Column, pattern: str, short: bool = False) -> Column:
    """array<start, end, value> of the matches in ``text``: code points, end exclusive. ``short``: there are a few at most."""
    both = lambda m, g: F.char_length(m) + F.char_length(g)
    span = lambda m, end: F.struct((end - F.char_length(m)).alias("start"), end.alias("end"), m.alias("value"))
    gaps = F.split(text, pattern, -1)
    sums = lambda n: F.transform(n, lambda x, i: x + F.aggregate(F.slice(n, F.lit(1), i), F.lit(0), _add))
    lengths = lambda found: F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), both)
    ends = lambda found: _let(lengths(found), sums) if short else running(lengths(found), _add, 0)
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.zip_with(found, ends(found), span))


def in_blocks(text: Column) -> Column:
    """The text as pieces of ``_CHARS`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHARS}}}"), F.lit(0))


def between(blocks: Column, lo: Column, hi: Column) -> Column:
    """The code points from ``lo`` to ``hi`` of the text that was cut into ``blocks``."""
    first = F.floor(lo / _CHARS).cast("int")
    parts = F.slice(blocks, first + 1, F.greatest(F.floor((hi - 1) / _CHARS).cast("int") - first + 1, F.lit(0)))
    return F.substring(F.array_join(parts, ""), lo - first * _CHARS + 1, F.greatest(hi - lo, F.lit(0)))


def hull(spans: Column) -> Column:
    """array<start, end, kind, last>: overlapping ones of the sorted ``spans`` as one, named after the first; ``last`` is the number of spans so far."""

    def joined(s: Column, reach: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(reach, i - 1)))
        upto = lambda h, k: F.coalesce(F.get(h, k + 1), F.size(s))
        one = lambda h, i, k: F.struct(F.get(s, i)["start"].alias("start"), F.get(reach, upto(h, k) - 1).alias("end"), F.get(s, i)["kind"].alias("kind"), upto(h, k).alias("last"))
        return _let(heads, lambda h: F.transform(h, lambda i, k: one(h, i, k)))

    whole = _let(running(F.transform(spans, lambda x: x["end"]), _larger, 0), lambda reach: joined(spans, reach))
    return F.when(F.size(spans) > 0, whole).otherwise(F.array().cast("array<struct<start:int,end:int,kind:int,last:int>>"))


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        digits = F.regexp_replace(value, "[^0-9]", "")
        return F.when(F.char_length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _base(text: Column, kind: str) -> Column:
    """array<start, kind, end, value> of the spans of a kind; the pattern runs only where the text can hold one."""
    no = KINDS.index(kind)
    needs = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.rlike(r"\+[0-9]")}[kind]
    good = F.filter(located(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    spans = F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return F.when(needs, spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))


def _entity(span: Column) -> Column:
    return F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), span["kind"] + 1), F.lower(span["value"]))


#: Merged spans that can lie within reach on one side of a span, as none is shorter than five characters.
_NEAR = REACH // 5 + 2


def _beside(base: Column, merged: Column, blocks: Column) -> Column:
    """array<entity, term>: the whole words within reach of each span that no span overlaps."""

    def near(s: Column, own: Column) -> Column:
        clear = lambda t: ~F.exists(own, lambda o: (o["start"] < t["end"]) & (t["start"] < o["end"]))
        moved = lambda found, at: F.transform(found, lambda t: F.struct((t["start"] + at).alias("start"), (t["end"] + at).alias("end"), t["value"].alias("value")))
        lo = F.greatest(s["start"] - REACH, F.lit(0))
        # a word that goes on in the span isn't whole
        opens, closes = (~s["value"].rlike(p) for p in (r"^\p{L}", r"\p{L}$"))
        before = F.filter(located(between(blocks, lo, s["start"]), _TERM, True), lambda t: ((lo == 0) | (t["start"] > 0)) & (opens | (t["end"] + lo < s["start"])))
        after = F.filter(located(between(blocks, s["end"], s["end"] + REACH), _TERM, True), lambda t: (t["end"] < REACH) & (closes | (t["start"] > 0)))
        return F.transform(F.filter(F.concat(moved(before, lo), moved(after, s["end"])), clear), lambda t: F.struct(_entity(s).alias("entity"), F.lower(t["value"]).alias("term")))

    def one(s: Column, group: Column) -> Column:
        return near(s, F.slice(merged, F.greatest(group - _NEAR, F.lit(1)), 2 * _NEAR))

    groups = F.flatten(F.transform(merged, lambda m, k: F.array_repeat(k + 1, m["last"] - F.coalesce(F.get(merged, k - 1)["last"], F.lit(0)))))
    return F.flatten(F.zip_with(base, groups, one))


def disclosing(found: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(term, entity, together, total, seen): the terms that give an entity away, for each one that they do, from counts over all documents."""
    pairs = found.select(F.explode("beside").alias("b")).groupBy("b.term", "b.entity").agg(F.count("*").alias("together"))
    likely = cut(pairs.filter(F.col("together") >= support))
    terms = cut(likely.select("term").distinct())
    words = found.select(F.explode(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0))).alias("word")).select(F.lower("word").alias("term"))
    if terms.count() <= BROADCAST_TERMS:
        words = words.join(F.broadcast(terms), "term", "left_semi")
    total = words.groupBy("term").agg(F.count("*").alias("total"))
    rows = found.count()
    seen = found.select(F.explode("base").alias("s")).select(_entity(F.col("s")).alias("entity")).groupBy("entity").agg(F.count("*").alias("seen"))
    known = cut(likely.join(total, "term")).join(cut(seen), "entity")
    share, often = F.col("together") / F.greatest("total", "together"), F.least(F.col("seen") / max(rows, 1), F.lit(0.5))
    return known.filter(F.log(share / often) >= disclosure * -F.log(often))


def _with_terms(text: Column, base: Column, terms: Column) -> Column:
    """The base spans and every place of ``terms`` that none of them overlaps, sorted by start and kind."""
    no = KINDS.index("term")
    places = F.filter(F.transform(located(text, _TERM), lambda t: F.struct(t["start"].alias("start"), F.lit(no).alias("kind"), t["end"].alias("end"), F.lower(t["value"]).alias("value"))), lambda t: F.array_contains(terms, t["value"]))

    def clear(every: Column) -> Column:
        ends = running(F.transform(every, lambda s: F.when(s["kind"] < no, s["end"]).otherwise(0)), _larger, 0)
        starts = F.reverse(running(F.reverse(F.transform(every, lambda s: F.when(s["kind"] < no, s["start"]).otherwise(2**31 - 1))), _smaller, 2**31 - 1))
        fits = lambda s, i, e, b: (s["kind"] < no) | ((F.coalesce(F.get(e, i - 1), F.lit(0)) <= s["start"]) & (F.get(b, i) >= s["end"]))
        return _let(ends, lambda e: _let(starts, lambda b: F.filter(every, lambda s, i: fits(s, i, e, b))))

    return _let(F.array_sort(F.concat(base, places)), clear)


def _found(docs: DataFrame, id_col: str, text_col: str, keep: list[str], disclosure: float, support: int) -> DataFrame:
    """(id, k0, k1, ... the ``keep`` columns, none, text, base, spans) for each row; ``none``: the text is null."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).isNull().alias("none"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"k{k}") for k, c in enumerate(keep)])
    rows = rows.withColumns({kind: _base(text, kind) for kind in KINDS[:4]})
    rows = rows.withColumn("base", F.array_sort(F.concat(*KINDS[:4])))
    empty = F.array().cast("array<struct<entity:string,term:string>>")
    beside = _let(hull(F.col("base")), lambda merged: _let(in_blocks(text), lambda blocks: _beside(F.col("base"), merged, blocks)))
    rows = rows.withColumn("beside", F.when(F.size("base") > 0, beside).otherwise(empty))
    names = ["id", *(f"k{k}" for k in range(len(keep))), "none", "text", "base"]
    found = cut(rows.select(*names, "beside").withColumn("row", F.monotonically_increasing_id()))
    telling = cut(disclosing(found, disclosure, support).select("term").distinct())
    words = found.select("row", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)))).alias("word")).select("row", F.lower("word").alias("term"))
    small = telling.count() <= BROADCAST_TERMS
    own = words.join(F.broadcast(telling) if small else telling, "term", "left_semi").groupBy("row").agg(F.collect_set("term").alias("terms"))  # at most a document's words
    own = cut(own)
    size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.array_join("terms", " "))), F.lit(0)).alias("bytes")).first()
    if size["n"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES:
        own = F.broadcast(own)
    spans = F.when(F.col("terms").isNull(), F.col("base")).otherwise(_with_terms(text, F.col("base"), F.col("terms")))
    return found.drop("beside").join(own, "row", "left").select(*names, spans.alias("spans"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(``id_col``, k0, k1, ... the ``keep`` columns, base, spans) for each row of ``docs``.

    ``base`` and ``spans`` are array<start, kind, end, value>, sorted by start and kind (numbers in ``KINDS``); ``spans``
    has the base ones and the terms. A null or empty text has none. Null ids and repeated rows stay as they are and count
    as documents; columns outside ``keep`` aren't read, whatever their names; an empty table gives an empty result. Very
    long texts take time in proportion to their length.
    """
    keep = keep or []
    found = _found(docs, id_col, text_col, keep, disclosure, support)
    return found.select(F.col("id").alias(id_col), *[f"k{k}" for k in range(len(keep))], "base", "spans")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(``id_col``, ``keep`` columns, ``text_col``): each span is generalised to its kind in brackets; null texts stay null.

    Spans that overlap become one, named after the first. Text outside spans stays as it is.
    """
    keep = keep or []
    found = _found(docs, id_col, text_col, keep, disclosure, support)
    text = F.col("text")
    label = lambda s: F.get(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), s["kind"])

    def joined(m: Column, blocks: Column) -> Column:
        pieces = F.transform(m, lambda s, i: F.concat(between(blocks, F.coalesce(F.get(m, i - 1)["end"], F.lit(0)), s["start"]), label(s)))
        return F.concat(F.array_join(pieces, ""), between(blocks, F.element_at(m, -1)["end"], F.char_length(text)))

    clean = F.when(F.size("spans") > 0, _let(hull(F.col("spans")), lambda m: _let(in_blocks(text), lambda blocks: joined(m, blocks)))).otherwise(F.when(~F.col("none"), text))
    return found.select(F.col("id").alias(id_col), *[F.col(f"k{k}").alias(c) for k, c in enumerate(keep)], clean.alias(text_col))


def described(spans: str, kinds: list[str] | None = None) -> Column:
    """kind:start:end of the spans, joined by commas."""
    names = F.array(*map(F.lit, kinds or KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans by the plain patterns; for tests."""
    import re

    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in plain.items():
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits[::-1])) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def brute_force_terms(texts: list[str | None], disclosure: float = DISCLOSURE, support: int = SUPPORT) -> set[str]:
    """The terms that give an entity away, by plain loops; for tests."""
    import math

    import regex

    together, total, seen = Counter(), Counter(), Counter()
    for text in texts:
        text = text or ""
        words = [(m.start(), m.end(), m[0].lower()) for m in regex.finditer(r"\p{L}{3,}+", text)]
        total.update(w for _, _, w in words)
        spans = brute_force(text)
        for kind, start, end in spans:
            entity = f"{kind}:{text[start:end].lower()}"
            seen[entity] += 1
            for a, b, w in words:
                left = b <= start and (a >= start - REACH + 1 or (a >= start - REACH and start <= REACH))
                if (left or (a >= end and b < end + REACH)) and not any(s < b and a < e for _, s, e in spans):
                    together[w, entity] += 1
    out = set()
    for (w, entity), n in together.items():
        often = min(seen[entity] / max(len(texts), 1), 0.5)
        if n >= support and math.log(n / max(total[w], n) / often) >= disclosure * -math.log(often):
            out.add(w)
    return out
