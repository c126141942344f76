"""Text operators: tokens, retrieval, chunking, mention tagging, entity resolution from mentions."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.operators import resemble, surfaces
from chronoweave.operators.journal import numbered, slug
from chronoweave.operators.traverse import components
from chronoweave.runtime import Workspace, small

K1, B = 1.5, 0.75


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def normalized(text: Column) -> Column:
    """White space collapsed and trimmed, lower case with sharp s as ss."""
    return F.replace(F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " "))), F.lit("ß"), F.lit("ss"))


def char_ngrams(form: Column, n: int = 3) -> Column:
    """N-grams of the form padded by one blank on each side; a form too short for one is its own."""
    padded = F.concat(F.lit(" "), form, F.lit(" "))
    size = F.length(padded)
    return F.when(size <= n, F.array(form)).otherwise(F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(padded, i, F.lit(n))))


def bm25(documents: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, doc_id, score, place): the ``k`` best of each query, positive scores only, ties to the smaller id.

    ``documents`` has doc_id and text, ``queries`` query_id and text; a term repeated in a query counts again. Only postings of
    query terms are kept: the query vocabulary is sent to the documents if it is small enough, and each document's terms
    are counted before anything is shuffled.
    """
    lengths = documents.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("t")).select("doc_id", "t", F.size("t").alias("len"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    asked = queries.select("query_id", F.explode(tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    vocabulary = small(asked.select("term").distinct())
    postings = lengths.select("doc_id", "len", F.explode("t").alias("term")).join(vocabulary, "term", "left_semi").groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = asked.join(df, "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = postings.join(weights, "term").groupBy("query_id", "doc_id").agg(F.sum(gain * F.col("times")).alias("score")).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)  # Spark keeps k rows of each query before it shuffles


def tfidf(items: DataFrame) -> DataFrame:
    """(block, id, term, weight, df): smoothed tf-idf within the block, scaled to length 1. ``items`` has block, id, terms."""
    tf = items.select("block", "id", F.explode("terms").alias("term")).groupBy("block", "id", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = items.groupBy("block").agg(F.countDistinct("id").alias("n"))
    df = tf.groupBy("block", "term").agg(F.count(F.lit(1)).alias("df")).join(small(n), "block")
    raw = tf.join(df, ["block", "term"]).withColumn("raw", F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1))
    norm = raw.groupBy("block", "id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, ["block", "id"]).select("block", "id", "term", (F.col("raw") / F.col("norm")).alias("weight"), "df")


def sections(text: str | None) -> list[tuple[str, int, str]]:
    """(breadcrumb, offset of the first character that is not blank, text) of each section; '#' inside fences is no heading."""
    out: list[tuple[str, int, str]] = []
    trail: list[tuple[int, str]] = []
    crumb, begin, at, fenced = "", 0, 0, False

    def close(end: int) -> None:
        body = (text or "")[begin:end]
        if body.strip():
            lead = len(body) - len(body.lstrip())
            out.append((crumb, begin + lead, body.strip()))

    for line in (text or "").splitlines(keepends=True):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        head = None if fenced else re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if head:
            close(at)
            level = len(head.group(1))
            trail = [t for t in trail if t[0] < level] + [(level, head.group(2))]
            crumb, begin = " > ".join(t for _, t in trail), at
        at += len(line)
    close(at)
    return out


def chunk_markdown(documents: DataFrame) -> DataFrame:
    """(path, section, offset, text, chunk_id) of every section of every text, whole texts in one vectorised pass."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, s, o, t) for p, x in zip(f["path"], f["text"], strict=True) for s, o, t in sections(x)]
            yield pd.DataFrame(rows, columns=["path", "section", "offset", "text"])

    cut = documents.select("path", "text").where("text is not null").mapInPandas(run, "path string, section string, offset int, text string")
    nul = F.lit("\x00")
    key = F.concat("path", nul, "section", nul, F.col("offset").cast("string"), nul, "text", nul)
    return cut.withColumn("chunk_id", F.substring(F.sha1(key), 1, 16))


def pack_passages(documents: DataFrame, words: int = 150) -> DataFrame:
    """(doc_id, idx, text): paragraphs (parted by blank lines) in order, put together as long as they stay within ``words`` words; none is divided.

    Null and blank texts have no passage. The fold over a document's paragraphs runs in the JVM.
    """
    paragraphs = F.filter(F.transform(F.split("text", r"\n(?U:\s*)\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    sized = F.transform(paragraphs, lambda p: F.struct(p.alias("p"), F.size(F.split(p, r"(?U)\s+")).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"), F.lit(0).alias("size"))
    glued = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit("\n\n"), b))
    full = lambda a, x: (a["size"] > 0) & (a["size"] + x["n"] > words)
    step = lambda a, x: F.when(full(a, x), F.struct(F.concat(a["done"], F.array(a["held"])).alias("done"), x["p"].alias("held"), x["n"].alias("size"))).otherwise(
        F.struct(a["done"].alias("done"), glued(a["held"], x["p"]).alias("held"), (a["size"] + x["n"]).alias("size"))
    )
    passages = F.aggregate(sized, start, step, lambda a: F.when(a["size"] > 0, F.concat(a["done"], F.array(a["held"]))).otherwise(a["done"]))
    return documents.where("text is not null").select("doc_id", F.posexplode(passages).alias("idx", "text"))


def chunk_ticket(tickets: DataFrame) -> DataFrame:
    """(path, section, text) of a ticket's summary, description and comment bodies; broken JSON gives nothing."""
    v = tickets.select("path", F.expr("try_parse_json(text)").alias("v"))
    field = lambda p: F.expr(f"try_variant_get(v, '$.fields.{p}', 'string')")
    comments = F.expr("transform(try_variant_get(v, '$.fields.comment.comments', 'array<variant>'), (c, i) -> struct(concat('fields.comment.comments[', i, '].body') as section, try_variant_get(c, '$.body', 'string') as text))")
    fixed = F.array(*[F.struct(F.lit(f"fields.{p}").alias("section"), field(p).alias("text")) for p in ("summary", "description")])
    rows = v.select("path", F.explode(F.concat(fixed, F.coalesce(comments, F.array().cast("array<struct<section:string,text:string>>")))).alias("c"))
    return rows.select("path", "c.*").where("trim(text) <> ''")


def tag(text: str, surfaces: list[tuple[str, str]]) -> list[tuple[int, int, str]]:
    """(offset, length, entity) of word-bounded occurrences, longest surfaces first; what overlaps a claimed span is skipped."""
    claimed: list[tuple[int, int, str]] = []
    for form, entity in surfaces:
        for m in re.finditer(rf"(?<![\w'’]){re.escape(form)}(?![\w'’])", text):
            if not any(s < m.end() and m.start() < e for s, e, _ in claimed):
                claimed.append((m.start(), m.end(), entity))
    return sorted((s, e - s, x) for s, e, x in claimed)


def tag_mentions(documents: DataFrame, roster: DataFrame, held: int = surfaces.HELD_SURFACES) -> DataFrame:
    """(doc_id, offset, length, entity_id) of the roster's surfaces (surface, entity_id; one entity each) in every text.

    Up to ``held`` surfaces are sent to every worker, which looks them up by their rarest word, so that no text is shuffled. Of more, candidates come
    from a join of each document's distinct words with the surfaces' first words. The order-dependent claiming runs per document on its own few candidates.
    """
    first = F.regexp_extract("surface", r"(?U)^\w+", 0)
    forms = roster.select("surface", "entity_id", first.alias("word")).where("word <> ''")
    table = forms.select("surface", "entity_id").limit(held + 1).toArrow()
    if table.num_rows <= held:
        return _tag_held(documents, table)
    seen = documents.where("text is not null").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0)))).alias("word"))
    near = seen.join(forms, "word").groupBy("doc_id").agg(F.collect_set(F.struct((-F.length("surface")).alias("l"), "surface", "entity_id")).alias("forms"))
    rows = documents.join(near, "doc_id").select("doc_id", "text", F.array_sort("forms").alias("forms"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(d, *m) for d, t, fs in zip(f["doc_id"], f["text"], f["forms"], strict=True) for m in tag(t, [(x["surface"], x["entity_id"]) for x in fs if x["surface"] in t])]
            yield pd.DataFrame(out, columns=["doc_id", "offset", "length", "entity_id"])

    return rows.mapInPandas(run, "doc_id bigint, offset int, length int, entity_id string")


def _tag_held(documents: DataFrame, table: pa.Table) -> DataFrame:
    shared, key = documents.sparkSession.sparkContext.broadcast(table), uuid.uuid4().hex

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms, by_word = surfaces.index(key, shared.value["surface"].to_pylist())
        entity = shared.value["entity_id"]
        for f in frames:
            out = []
            for d, t in zip(f["doc_id"], f["text"], strict=True):
                near = sorted(((-len(forms[i]), forms[i], i) for i in surfaces.candidates(t, forms, by_word)))
                out += [(d, *m[:2], entity[m[2]].as_py()) for m in tag(t, [(form, i) for _, form, i in near])]
            yield pd.DataFrame(out, columns=["doc_id", "offset", "length", "entity_id"])

    return documents.where("text is not null").select("doc_id", "text").mapInPandas(run, "doc_id bigint, offset int, length int, entity_id string")


def roster(nodes: DataFrame) -> DataFrame:
    """(surface, entity_id): the first claimant of a surface, by type and id, keeps it."""
    order = F.struct(F.array_position(F.array(*[F.lit(t) for t in ("Person", "Project", "Initiative", "Team", "Goal", "Department", "Company")]), F.col("type")), "id")
    return nodes.select("id", "type", F.explode("surfaces").alias("surface")).where("type in ('Person', 'Project', 'Initiative', 'Team', 'Goal', 'Department', 'Company')").groupBy("surface").agg(F.min_by("id", order).alias("entity_id"))


# Words that open a capitalised run without naming anybody, and the shape of a name's word.
OPENERS = "The This That These Those We Our Their Its They In On At As For And But Or If When While After Before During By With From All Each No Next Last First Today Now Per Both Some Many".split()
NAME_WORD = r"[A-Z][a-z]+(?:[-'’][A-Z][a-z]+)?"


def unresolved_names(documents: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, surface): distinct runs of at least two capitalised words on one line that no roster surface names.

    A run all of whose words are surfaces is two names side by side; one that opens with a sentence word is none. The words of all
    runs meet the roster in a join, as the runs do.
    """
    runs = documents.where("text is not null").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(rf"{NAME_WORD}(?:[ \t]+{NAME_WORD})+"), F.lit(0)))).alias("surface"))
    words = F.split("surface", "[ \t]+")
    open_ = runs.where(~words[0].isin(*OPENERS)).join(known.select("surface"), "surface", "left_anti")
    names = open_.select("surface").distinct().select("surface", F.explode(words).alias("word"))
    strange = names.join(known.select(F.col("surface").alias("word")).distinct(), "word", "left_anti").select("surface").distinct()
    return open_.join(strange, "surface", "left_semi").select("doc_id", "surface")


def resolve_mentions(mentions: DataFrame, ws: Workspace, merge_at: float = 0.7, held: int = resemble.HELD_FORMS) -> DataFrame:
    """(mention_id, entity): mentions of one type that name the same thing. ``mentions`` has id, type, surface.

    Equal normalized names merge outright; distinct names of a type are compared by tf-idf cosine of their character n-grams,
    and what reaches ``merge_at`` is joined into components named by their smallest form. The context of a mention plays no part.
    Up to ``held`` names are compared by workers that hold them all, without a shuffle of pairs; more by joins.
    """
    rows = mentions.select("id", F.coalesce("type", F.lit("")).alias("block"), normalized(F.col("surface")).alias("form")).where("form <> ''")
    names = ws.put(rows.select("block", "form").distinct(), keep=True)
    near = resemble.groups(names, ws, merge_at, held)
    if near is not None:
        return rows.join(small(near), ["block", "form"], "left").select(F.col("id").alias("mention_id"), F.coalesce("least", "form").alias("entity"), F.col("block").alias("type"))
    vectors = ws.put(tfidf(names.select("block", F.col("form").alias("id"), char_ngrams(F.col("form")).alias("terms"))), keep=True)
    # prefix filter on both sides, rarest terms first: without what lies behind their prefixes two unit vectors stay below the bound, so
    # those that reach it share a term of both prefixes, and common terms are hardly ever in one
    behind = Window.partitionBy("block", "id").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rare = vectors.withColumn("rest", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(behind))).where(F.col("rest") >= merge_at - 1e-9).select("block", "term", "id")
    pairs = rare.withColumnRenamed("id", "x").join(rare.withColumnRenamed("id", "y"), ["block", "term"]).where("x < y").select("block", "x", "y").distinct()
    a, b = vectors.select("block", F.col("id").alias("x"), "term", F.col("weight").alias("wx")), vectors.select("block", F.col("id").alias("y"), "term", F.col("weight").alias("wy"))
    close = pairs.join(a, ["block", "x"]).join(b, ["block", "y", "term"]).groupBy("block", "x", "y").agg(F.sum(F.col("wx") * F.col("wy")).alias("cosine")).where(F.col("cosine") >= merge_at)
    key = lambda c: F.concat("block", F.lit("\x1f"), c)
    groups = components(close.select(key(F.col("x")).alias("a"), key(F.col("y")).alias("b")), ws)
    named = rows.withColumn("k", key(F.col("form"))).join(groups.select(F.col("id").alias("k"), "component"), "k", "left")
    return named.select(F.col("id").alias("mention_id"), F.split(F.coalesce("component", "k"), "\x1f")[1].alias("entity"), F.col("block").alias("type"))


def entities(mentions: DataFrame, resolved: DataFrame) -> DataFrame:
    """(entity_id, type, label, aliases, n_mentions): one row per resolved entity; ``mentions`` has id and surface, ``resolved`` mention_id, entity and type.

    The label is the form used most, then the longest, then the first in order. Ids are type:slug, numbered from the second holder on in the
    order of label and aliases.
    """
    forms = mentions.select(F.col("id").alias("mention_id"), "surface").join(resolved, "mention_id").groupBy("type", "entity", "surface").agg(F.count(F.lit(1)).alias("n"))
    best = forms.groupBy("type", "entity").agg(F.min_by("surface", F.struct(-F.col("n"), -F.length("surface"), F.col("surface"))).alias("label"), F.array_sort(F.collect_set("surface")).alias("aliases"), F.sum("n").alias("n_mentions"))
    kind = F.lower(F.when(F.col("type") != "", F.col("type")).otherwise("entity"))
    based = best.withColumn("base", F.concat(kind, F.lit(":"), slug(F.col("label"), "entity")))
    return numbered(based, "base", ["label", "aliases", "entity"]).select(F.col("unique_id").alias("entity_id"), "type", "label", "aliases", "n_mentions")
