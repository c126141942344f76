"""Queries on text: scalar functions, retrieval, chunking, tagging, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import graph as g
from chronoweave.functions import stable
from chronoweave.operators import flatten, journal, kgbuild, text
from chronoweave.plans.graph_queries import PRE
from chronoweave.plans.problems import LISTS, P6_SQL, p6_flat
from chronoweave.runtime import Workspace, read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, pre: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = pre + sql
        return f

    return add


@query("""
select item_id, trim(regexp_replace(lower(passage), '\\s+', ' ', 'g')) normalized, len(regexp_extract_all(lower(passage), '[a-z0-9]+')) n_tokens,
 coalesce(nullif(trim(regexp_replace(lower(trim(suite)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'x') slug, substr(sha1(suite || chr(0) || lang || chr(0) || passage || chr(0)), 1, 16) chunk_id,
 greatest(1, length(passage) // 4) token_estimate, instr(passage, 'the') - 1 as locate_the, length(passage) - length(replace(passage, '.', '')) + 1 sentence_no from eval_items""")
def text_functions(spark: SparkSession, folder: str) -> DataFrame:
    p, nul = F.col("passage"), F.lit("\x00")
    return read_table(spark, folder, "eval_items").select(
        "item_id", text.normalized(p).alias("normalized"), F.size(text.tokens(p)).cast("bigint").alias("n_tokens"), journal.slug(F.col("suite")).alias("slug"),
        F.substring(F.sha1(F.concat("suite", nul, "lang", nul, p, nul)), 1, 16).alias("chunk_id"), F.greatest(F.lit(1), F.floor(F.length(p) / 4)).cast("bigint").alias("token_estimate"),
        (F.instr(p, "the") - 1).cast("bigint").alias("locate_the"), (F.length(p) - F.length(F.replace(p, F.lit("."), F.lit(""))) + 1).cast("bigint").alias("sentence_no"),
    )


BM25 = """
with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') t from documents),
st as (select count(*) n, avg(len(t)) al from d),
q as (select item_id query_id, term, count(*) times from (select item_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) term from eval_items) group by all),
p as (select doc_id, len, term, count(*) tf from (select doc_id, len(t) len, unnest(t) term from d) where term in (select term from q) group by all),
df as (select term, count(*) df from p group by term),
s as (select query_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / al))), 9) score from q join p using (term) join df using (term), st group by all)
select query_id, doc_id, round(score, 5) score, row_number() over (partition by query_id order by score desc, doc_id) place from s where score > 0 qualify place <= 5"""


@query(BM25)
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five best documents for each test question."""
    items = read_table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))
    return text.bm25(read_table(spark, folder, "documents"), items).select("query_id", "doc_id", F.round("score", 5).alias("score"), F.col("place").cast("bigint").alias("place"))


@query("""
with p as (select item_id, suite, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) ts, regexp_extract_all(lower(question), '[a-z0-9]+') ta from eval_items),
tf as (select suite, item_id, term, count(*) tf from (select suite, item_id, unnest(ta) term from p) group by all),
n as (select suite, count(distinct item_id) n from p group by suite), df as (select suite, term, count(*) df from tf group by all),
w as (select suite, item_id, term, tf * (ln((n + 1) / (df + 1)) + 1) w from tf join n using (suite) join df using (suite, term)),
u as (select *, w / sqrt(sum(w * w) over (partition by item_id)) v from w)
select a.item_id a, b.item_id b, round(sum(a.v * b.v), 6) cosine from u a join u b using (suite, term) where a.item_id < b.item_id group by a.item_id, b.item_id having sum(a.v * b.v) >= 0.5""")
def tfidf_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of test questions of one suite that are alike."""
    items = read_table(spark, folder, "eval_items").select(F.col("suite").alias("block"), F.col("item_id").alias("id"), text.tokens(F.col("question")).alias("terms"))
    v = text.tfidf(items)
    other = v.select("block", "term", F.col("id").alias("b"), F.col("weight").alias("w2"))
    pairs = v.join(other, ["block", "term"]).where("id < b").groupBy(F.col("id").alias("a"), "b").agg(F.sum(F.col("weight") * F.col("w2")).alias("cosine"))
    return pairs.where("cosine >= 0.5").withColumn("cosine", F.round("cosine", 6))


SURFACES = """
sf as (select distinct lower(trim(f)) surface, entity_id from (select canonical f, entity_id from aliases union all select unnest(aliases), entity_id from aliases union all select surface_form, entity_id from mentions)
  where trim(f) <> '' and entity_id is not null)"""


def _surfaces(spark: SparkSession, folder: str) -> DataFrame:
    """(surface, entity_id): every form under which the alias table or a mention knows an entity."""
    aliases, mentions = read_table(spark, folder, "aliases"), read_table(spark, folder, "mentions")
    named = aliases.select("entity_id", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array()))).alias("surface"))
    forms = named.unionByName(mentions.select("entity_id", F.col("surface_form").alias("surface"))).select(F.lower(F.trim("surface")).alias("surface"), "entity_id")
    return forms.where("surface <> '' and entity_id is not null").distinct()


@query("with" + SURFACES + " select surface, count(*) n_entities, string_agg(entity_id, '|' order by entity_id) entities from sf group by surface")
def alias_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = _surfaces(spark, folder).groupBy("surface")
    return rows.agg(F.count(F.lit(1)).alias("n_entities"), F.array_join(F.array_sort(F.collect_list("entity_id")), "|").alias("entities"))


def _roster(spark: SparkSession, folder: str) -> DataFrame:
    return text.roster(g.TemporalGraph.load(spark, folder).nodes.select("id", "type", g.surfaces().alias("surfaces")))


ROSTER = """
, so as (select id, type, list_position(['Person', 'Project', 'Initiative', 'Team', 'Goal', 'Department', 'Company'], type) o,
  list_filter(list_concat([coalesce(nullif(json_extract_string(props, '$.name'), ''), nullif(json_extract_string(props, '$.statement'), ''), nullif(json_extract_string(props, '$.title'), ''))], coalesce(aliases, [])), lambda x: x <> '') f from n),
ro as (select surface, arg_min(id, (o, id)) entity_id from (select id, o, unnest(f) surface from so where o > 0) group by surface)
"""


@query(ROSTER + "select surface, entity_id from ro", pre=PRE)
def roster(spark: SparkSession, folder: str) -> DataFrame:
    return _roster(spark, folder)


@query()
def mention_tagger(spark: SparkSession, folder: str) -> DataFrame:
    return text.tag_mentions(read_table(spark, folder, "documents").select("doc_id", "text"), _roster(spark, folder))


@query(ROSTER + r"""
, ru as (select distinct doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+(?:[-''’][A-Z][a-z]+)?(?:[ \t]+[A-Z][a-z]+(?:[-''’][A-Z][a-z]+)?)+')) surface from documents where text is not null),
wd as (select doc_id, surface, regexp_split_to_array(surface, '[ \t]+') w from ru where surface not in (select surface from ro)),
st as (select distinct surface from (select surface, unnest(w) x from wd) where x not in (select surface from ro))
select doc_id, surface from wd where surface in (select surface from st) and w[1] not in ("""
    + ", ".join(f"'{w}'" for w in text.OPENERS) + ")", pre=PRE)
def unresolved_names(spark: SparkSession, folder: str) -> DataFrame:
    return text.unresolved_names(read_table(spark, folder, "documents").where("text is not null"), _roster(spark, folder))


@query()
def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    return text.chunk_markdown(read_table(spark, folder, "documents").select(F.col("artifact_path").alias("path"), "text"))


@query(r"""
with recursive s as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*\n'), lambda x: regexp_replace(x, '^[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')), lambda x: x <> '') ps from documents where text is not null),
p as (select doc_id, k, ps[k] t, len(regexp_split_to_array(ps[k], '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) n from s, unnest(range(1, len(ps) + 1)) u(k)),
r(doc_id, k, idx, size) as (select doc_id, k, 0, n from p where k = 1
  union all select p.doc_id, p.k, case when r.size + p.n > 150 then idx + 1 else idx end, case when r.size + p.n > 150 then p.n else r.size + p.n end from r join p on p.doc_id = r.doc_id and p.k = r.k + 1)
select doc_id, idx, string_agg(t, chr(10) || chr(10) order by k) "text" from r join p using (doc_id, k) group by doc_id, idx""")
def pack_passages(spark: SparkSession, folder: str) -> DataFrame:
    return text.pack_passages(read_table(spark, folder, "documents"))


def _mention_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(id, type, surface) of every mention, typed by the node it names."""
    kinds = g.TemporalGraph.load(spark, folder).nodes.select(F.col("id").alias("entity_id"), "type")
    rows = read_table(spark, folder, "mentions").where("trim(surface_form) <> ''").join(kinds, "entity_id", "left")
    return rows.select(F.sha1(F.concat_ws("\x1f", "artifact_path", "entity_id", "surface_form", F.col("locator.offset").cast("string"))).alias("id"), "type", F.col("surface_form").alias("surface")).distinct()


@query()
def resolve_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions of one type whose names stand for one thing, all of the table."""
    with Workspace(spark, "resolve") as ws:
        return text.resolve_mentions(ws.put(_mention_rows(spark, folder), keep=True), ws)


@query()
def resolved_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The entities that the resolved mentions make up, with label, forms and id."""
    with Workspace(spark, "entities") as ws:
        rows = ws.put(_mention_rows(spark, folder), keep=True)
        return text.entities(rows, text.resolve_mentions(rows, ws)).withColumn("aliases", F.array_join("aliases", "|"))


@query("""
select source_path, count(distinct id) n_chunks, sum(length(text)) n_chars, min("offset") first_offset from (select distinct id, source_path, text, "offset" from chunks) group by source_path""")
def chunk_totals(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "chunks").select("id", "source_path", "text", "offset").distinct().groupBy("source_path")
    return rows.agg(F.countDistinct("id").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), F.min("offset").alias("first_offset"))


@query("""
, m as (select artifact_path, entity_id, locator."offset" o, locator.length l, surface_form from mentions where locator is not null)
select artifact_path, count(*) n_overlaps from (select *, max(o + l) over (partition by artifact_path order by o, l, entity_id, surface_form rows between unbounded preceding and 1 preceding) held from (select distinct * from m)) where o < held group by artifact_path""", pre=PRE)
def overlapping_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Artifacts whose located mentions overlap: each span is held against the furthest end before it."""
    from pyspark.sql.window import Window

    m = read_table(spark, folder, "mentions").where("locator is not null").select("artifact_path", "entity_id", F.col("locator.offset").alias("o"), F.col("locator.length").alias("l"), "surface_form").distinct()
    before = Window.partitionBy("artifact_path").orderBy("o", "l", "entity_id", "surface_form").rowsBetween(Window.unboundedPreceding, -1)
    return m.withColumn("held", F.max(F.col("o") + F.col("l")).over(before)).where("o < held").groupBy("artifact_path").agg(F.count(F.lit(1)).alias("n_overlaps"))


@query()
def alias_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Which entities the chunks name by any of their forms. Leftmost and longest claims depend on each other, which SQL cannot say; a test holds it against brute force."""
    with Workspace(spark, "aliases") as ws:
        return kgbuild.resolve_aliases(read_table(spark, folder, "chunks").groupBy("id").agg(F.max("text").alias("text")), ws.put(_surfaces(spark, folder), keep=True))


@query("""
with d as (select artifact_path, min(text) t from documents group by artifact_path)
select m.artifact_path, entity_id, surface_form, greatest(coalesce(locator.line, 1), 1) line, string_split(d.t, chr(10))[greatest(coalesce(locator.line, 1), 1)] snippet from mentions m join d using (artifact_path)""")
def mention_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions of artifacts whose text is here, with the line they stand on."""
    texts = read_table(spark, folder, "documents").groupBy(F.col("artifact_path").alias("path")).agg(F.min("text").alias("text"))
    mentions = read_table(spark, folder, "mentions")
    return kgbuild.snippets(mentions.join(texts.select(F.col("path").alias("artifact_path")), "artifact_path", "left_semi"), texts)


@query(P6_SQL + "select rid bundle_id, x->>'$.entity_id' entity_id, count(distinct item_no) n from k where ln = 'mentions' and x->>'$.entity_id' is not null group by all")
def bundle_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions of the bundles by entity, however the bundle is wrapped, encoded or divided into parts."""
    items = flatten.table(p6_flat(spark, folder, "mentions"), LISTS["mentions"], 0).where("entity_id is not null")
    return items.groupBy(F.col("record_id").alias("bundle_id"), "entity_id").agg(F.countDistinct("no_0").alias("n"))


@query()
def seeded_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Reproducible arrival times for every project."""
    keys = g.TemporalGraph.load(spark, folder).of_type("Project").select(F.col("id").alias("key"))
    return stable.arrivals(keys, 7, 0.5, 30)
