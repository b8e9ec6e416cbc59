"""Personal data: base patterns, and terms that reveal protected entities by co-occurrence."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import arrow_schema, giving_back
from framesift.operators.skew import join_to_unique
from framesift.session import save_table

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT_GROUPS = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")  # takes a whole run of digits, so it never retries inside
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"\w+")

DISCLOSURE = 0.8  # share of an entity's information from which a term is too telling
PREFIX = 3  # characters that remain of a generalised term, but at most half of it
REMOVED = "[TERM]"
TERM_ROWS = 300_000  # distinct terms counted in a task before they are passed on

FOUND = (
    "doc_id long, mark long, spans array<struct<kind:int,start:int,end:int>>, entities array<long>, "
    "words array<struct<term:string,starts:array<int>,ends:array<int>>>"
)


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ decides one match at most: the run of local characters before it, the domain after it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of e-mail addresses, IP addresses, card and phone numbers, in that order."""
    out = [(0, s, e) for s, e in emails(text)]
    if "." in text:
        for m in DIGIT_GROUPS.finditer(text):
            if m[1] and all(len(q) <= 3 and int(q or "0") <= 255 for q in (p.lstrip("0") for p in m[0].split("."))):
                out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def entities_of(text: str, spans: list[tuple[int, int, int]]) -> list[int]:
    """Hashes of the distinct entities; a card or phone number is its digits, whatever stands between them."""
    from xxhash import xxh64_intdigest

    out = set()
    for kind, start, end in spans:
        value = text[start:end].lower()
        if kind in (2, 3):
            value = re.sub(r"[^0-9]", "", value)
        n = xxh64_intdigest(f"{KINDS[kind]}:{value}".encode("utf-8", "replace"))
        out.add(n - (1 << 64) if n >= 1 << 63 else n)
    return sorted(out)


def words_of(text: str, spans: list[tuple[int, int, int]]) -> dict[str, tuple[list[int], list[int]]]:
    """Starts and ends of every term of the text outside the spans; terms that stand only inside have none."""
    taken = sorted((s, e) for _, s, e in spans)
    out: dict[str, tuple[list[int], list[int]]] = {}
    at = covered = 0
    for m in TERM.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            covered = max(covered, taken[at][1])
            at += 1
        starts, ends = out.setdefault(m[0].lower(), ([], []))
        if covered <= m.start():
            starts.append(m.start())
            ends.append(m.end())
    return out


def generalised(term: str) -> str:
    """What may stand for a term: its first characters and ``~``, which no term holds; ``~`` alone shows nothing."""
    return term[: min(PREFIX, len(term) // 2)] + "~"


def terms_and_prefixes(text: str) -> set[str]:
    terms = {t.lower() for t in set(TERM.findall(text))}
    return terms | {generalised(t) for t in terms}


def found_entities(docs: DataFrame) -> DataFrame:
    """Base spans, entities and, where there are any, all words; a row per row of ``docs``, stored; see FOUND."""
    schema = arrow_schema(FOUND)

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            columns = [[], [], []]
            for text in batch.column(2).to_pylist():
                found = base_spans(text or "")
                columns[0].append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                columns[1].append(entities_of(text, found) if found else [])
                words = words_of(text, found) if found else {}
                columns[2].append([{"term": t, "starts": s, "ends": e} for t, (s, e) in words.items()])
            arrays = [pa.array(c, schema.field(i).type) for i, c in enumerate(columns, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark_of("text").alias("mark"), "text")
    return save_table(rows.mapInArrow(giving_back(find), FOUND), "private-found")


def mark_of(text: str) -> Column:
    return F.coalesce(F.xxhash64(text), F.lit(0))


def term_counts(docs: DataFrame) -> DataFrame:
    """term, n: in how many rows of ``docs`` each term occurs; prefixes are terms that end in ``~``."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(counter: Counter):
            return pa.RecordBatch.from_arrays([pa.array(list(counter)), pa.array(list(counter.values()), pa.int64())], names=["term", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(terms_and_prefixes(text))
                if len(seen) > TERM_ROWS:
                    yield rows(seen)
                    seen = Counter()
        if seen:
            yield rows(seen)

    counted = docs.filter("text IS NOT NULL").select("text").mapInArrow(giving_back(count), "term string, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n"))


def document_groups(found: DataFrame) -> DataFrame:
    """doc_id, mark, grp, n_e, w: the groups of entities in each document with any, stored; w counts its rows.

    Entities of the same documents have the same counts with every term, so they are one group: a
    document with a long list of entities that stand nowhere else has one group, not one per entity.
    """
    held = found.filter(F.size("entities") > 0).select("doc_id", "mark", F.explode("entities").alias("entity"))
    held = save_table(held.groupBy("entity", "doc_id", "mark").agg(F.count(F.lit(1)).alias("w")), "private-held")
    where = [F.bit_xor(F.xxhash64(F.lit(i), F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "mark")) for i in (1, 2)]
    same = held.groupBy("entity").agg(
        F.sum("w").alias("n_e"), F.count(F.lit(1)).alias("docs"), where[0].alias("x1"), where[1].alias("x2")
    )
    grp = F.struct("docs", "x1", "x2").alias("grp")
    same = save_table(same.select("entity", grp, "n_e", "docs"), "private-same")
    groups = join_to_unique(held, same, ["entity"], weight="docs")
    return save_table(groups.groupBy("doc_id", "mark", "grp", "n_e", "w").agg(F.lit(1).alias("one")).drop("one"), "private-groups")


def telling_terms(found: DataFrame, groups: DataFrame, docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, mark, term, shown: the terms that tell too much on an entity of their document, and what is shown instead.

    Counted over all rows and whole texts: n of them, n_e with the entity, n_t with the term, n_et
    with both. PMI = log(n n_et / (n_e n_t)) is the information the term gives on the entity; it is
    at most log(n / n_e), the entity's own. A term is too telling from a share of ``disclosure`` on,
    however rare the pair. It is then generalised to its first characters, at most half of them, if
    these stay below the share for all entities of the document, else removed.

    As n_et <= n_e, only terms with n_t <= n_e (n / n_e) ** (1 - disclosure) can reach the share. The
    terms of a document are cut to those before they meet its entities. A term that stands nowhere
    else gives all information on every entity of its document and meets none of them.
    """
    n = docs.count()
    limit = F.col("n_e") * F.pow(F.lit(float(max(n, 1))) / F.col("n_e"), F.lit(1 - disclosure)) * F.lit(1 + 1e-9) + F.lit(1e-6)
    per_doc = groups.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(
        F.max(limit).alias("limit"), F.max("w").alias("w"), F.min("n_e").alias("least")
    )
    per_doc = save_table(per_doc, "private-docs")
    terms = F.transform("words", lambda w: w["term"])
    short = F.transform(terms, lambda t: F.concat(F.substring(t, F.lit(1), F.least(F.lit(PREFIX), F.floor(F.length(t) / 2).cast("int"))), F.lit("~")))
    both = F.concat(terms, F.array_distinct(short))
    known = found.filter(F.size("entities") > 0).dropDuplicates(["doc_id", "mark"]).select("doc_id", "mark", both.alias("terms"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    rows = known.join(per_doc, same).select("doc_id", "mark", "limit", "w", "least", F.explode("terms").alias("term"))
    most = per_doc.agg(F.max("limit")).first()[0] or 0.0  # no term above the highest limit matters
    counts = save_table(term_counts(docs).withColumnRenamed("n", "n_t").filter(F.col("n_t") <= F.lit(float(most))), "private-counts")
    rows = save_table(join_to_unique(rows, counts, ["term"], weight="n_t").filter(F.col("n_t") <= F.col("limit")), "private-rare")
    sole = rows.filter((F.col("n_t") == F.col("w")) & (F.col("least") < n)).select("doc_id", "mark", "term")
    rest = rows.filter(F.col("n_t") > F.col("w")).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "term", "n_t")
    met = groups.withColumn("limit", limit).join(rest, same & (F.col("n_t") <= F.col("limit")))
    met = save_table(met.select("doc_id", "mark", "grp", "n_e", "w", "term", "n_t"), "private-met")
    pairs = met.groupBy("grp", "n_e", "term", "n_t").agg(F.sum("w").alias("n_et"), F.count(F.lit(1)).alias("docs"))
    own = F.log(F.lit(float(max(n, 1))) / F.col("n_e"))
    gained = F.log(F.lit(float(max(n, 1))) * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    share = F.when(own > 0, gained / own).otherwise(F.lit(0.0))
    over = save_table(pairs.filter(share >= disclosure).select("grp", "term", "docs"), "private-over")
    told = join_to_unique(met.select("doc_id", "mark", "grp", "term"), over, ["grp", "term"], weight="docs")
    told = save_table(sole.unionByName(told.select("doc_id", "mark", "term")).distinct(), "private-told")
    wide = told.filter(F.col("term").endswith("~")).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("term").alias("_prefix"))
    few = F.least(F.lit(PREFIX), F.floor(F.length("term") / 2).cast("int"))
    told = told.filter(~F.col("term").endswith("~")).withColumn("prefix", F.concat(F.substring("term", F.lit(1), few), F.lit("~")))
    shown = F.when(F.col("_prefix").isNotNull() | (F.col("prefix") == "~"), F.lit(REMOVED)).otherwise(F.col("prefix"))
    return told.join(wide, same & (F.col("prefix") == F.col("_prefix")), "left").select("doc_id", "mark", "term", shown.alias("shown"))


def private_spans(docs: DataFrame) -> DataFrame:
    """doc_id, mark, spans per row of ``docs`` (doc_id, text); spans are (kind, start, end, shown), sorted.

    ``kind`` is a place in KINDS; positions count code points. Base spans have their kind as
    ``shown``; further spans are all places of a term (letters, digits and ``_`` in a row, of any
    length) that is telling for an entity of the document. If several entities find a term or its first
    characters telling, the one that shows least decides. Null texts count as empty; repeated rows
    get the same spans; an empty table gives no row; further columns are ignored. Texts are searched
    whole, in time that grows with their length; a task holds the words of one Arrow batch.
    """
    found = found_entities(docs)
    telling = telling_terms(found, document_groups(found), docs)
    telling = save_table(telling, "private-telling")
    places = found.filter(F.size("entities") > 0).dropDuplicates(["doc_id", "mark"]).select("doc_id", "mark", F.explode("words").alias("word"))
    places = places.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "word.*").filter(F.size("starts") > 0)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    more = places.withColumnRenamed("term", "_term").join(telling, same & (F.col("term") == F.col("_term")))
    spans_of = F.transform(F.arrays_zip("starts", "ends"), lambda p: F.struct(
        F.lit(KINDS.index("term")).alias("kind"), p["starts"].alias("start"), p["ends"].alias("end"), F.col("shown").alias("shown")))
    more = more.groupBy("_id", "_mark").agg(F.flatten(F.collect_list(spans_of)).alias("more"))  # the terms of one document
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.get(labels, s["kind"]).alias("shown")))
    none = F.array().cast("array<struct<kind:int,start:int,end:int,shown:string>>")
    joined = found.join(save_table(more, "private-more"), same, "left")
    more = F.coalesce("more", none)
    return joined.select("doc_id", "mark", F.array_sort(F.concat(base, more)).alias("spans"))


def masked(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with every span of ``private_spans`` replaced by what it shows; n_chars follows the text."""

    def replace(texts, spans):
        import pandas as pd

        out = []
        for text, found in zip(texts, spans):
            if found is None:  # nothing to hide, or no text
                out.append(text)
                continue
            parts, at = [], 0
            for s in sorted(found, key=lambda s: (s["start"], s["kind"])):
                if s["start"] >= at:
                    parts += [text[at : s["start"]], s["shown"]]
                at = max(at, s["end"])
            out.append("".join(parts) + text[at:])
        return pd.Series(out)

    put = F.pandas_udf(replace, "string")
    some = save_table(spans.filter(F.size("spans") > 0).dropDuplicates(["doc_id", "mark"]), "private-some")
    some = some.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("spans").alias("_spans"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (mark_of("text") == F.col("_mark"))
    rows = docs.join(some, same, "left").withColumn("text", put("text", "_spans"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return rows.select(*docs.columns)


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def privacy_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_term per row of ``docs``."""
    rows = private_spans(docs)

    def n(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    term = KINDS.index("term")
    base = F.filter("spans", lambda s: s["kind"] < term)
    return rows.select(
        "doc_id", *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"),
    )
