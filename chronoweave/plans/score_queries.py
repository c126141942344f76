"""Queries that grade sets and graphs, and question generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import graph as g
from chronoweave.operators import score, traverse
from chronoweave.plans.graph_queries import LATER, PRE, PROV, THEN, _provenance_pairs
from chronoweave.runtime import Workspace, read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, pre: str = PRE):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = pre + sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# What each person works with: everything is expected; a rule that only knows the graph at an instant, or only mentions, predicts.
_TOUCH = "('works_on', 'leads', 'member_of', 'authored', 'reviewed')"


def _sets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    t = g.TemporalGraph.load(spark, folder)
    held = lambda x: x.edges.where(f"type in {_TOUCH} and src is not null and dst is not null").select(F.col("src").alias("id"), F.col("dst").alias("member"))
    people = t.of_type("Person").select("id", F.coalesce(g.prop("department"), F.lit("")).alias("department"))
    said = read_table(spark, folder, "mentions").select(F.col("entity_id").alias("id"), F.col("artifact_path").alias("path")).join(g.artifacts_by_path(t.nodes), "path").select("id", F.col("artifact_id").alias("member"))
    return people, held(t), {"at_then": held(t.at(THEN)), "at_later": held(t.at(LATER)), "mentions": said}


SETS = f"""
, ex as (select distinct src id, dst member from e where type in {_TOUCH} and src is not null and dst is not null),
pr as (select distinct 'at_then' runner, src id, dst member from e where type in {_TOUCH} and src is not null and dst is not null and created <= timestamp '{THEN}'
 union select 'at_later', src, dst from e where type in {_TOUCH} and src is not null and dst is not null and created <= timestamp '{LATER}'
 union select 'mentions', entity_id, artifact_id from mentions join art on artifact_path = path),
pe as (select id, coalesce({'json_extract_string(props, ' + repr('$.department') + ')'}, '') department from n where type = 'Person'),
ru(runner) as (values ('at_then'), ('at_later'), ('mentions')),
ne as (select id, count(*) k from ex group by id), np as (select runner, id, count(*) k from pr group by all), nb as (select runner, id, count(*) k from pr join ex using (id, member) group by all),
gr as (select ru.runner, pe.id, department, coalesce(ne.k, 0) a, coalesce(np.k, 0) b, coalesce(nb.k, 0) c from pe cross join ru left join ne using (id) left join np on np.id = pe.id and np.runner = ru.runner left join nb on nb.id = pe.id and nb.runner = ru.runner),
sc as (select *, case when a = 0 and b = 0 then 1.0 when b = 0 then 0.0 else c / b end::double p, case when a = 0 and b = 0 then 1.0 when a = 0 then 0.0 else c / a end::double r,
 case when a = 0 and b = 0 then 1.0 when c = 0 then 0.0 else 2.0 * c / (a + b) end::double f1, a = c and b = c exact from gr)
"""


@query(SETS + "select id, a n_expected, b n_predicted, c n_both, round(p, 6) p, round(r, 6) r, round(f1, 6) f1, exact from sc where runner = 'at_then'")
def set_prf_items(spark: SparkSession, folder: str) -> DataFrame:
    people, expected, predicted = _sets(spark, folder)
    return rounded(score.grade(expected, predicted["at_then"], people.select("id"), "id"), "p", "r", "f1")


@query(SETS + "select case when grouping(department) = 1 then 'all' else department end department, round(avg(p), 6) p, round(avg(r), 6) r, round(avg(f1), 6) f1, round(avg(exact::integer), 6) exact_rate, count(*) n from sc where runner = 'at_then' group by rollup (department)")
def macro_prf(spark: SparkSession, folder: str) -> DataFrame:
    people, expected, predicted = _sets(spark, folder)
    return rounded(score.macro(score.grade(expected, predicted["at_then"], people, "id"), "department"), "p", "r", "f1", "exact_rate")


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    people, expected, predicted = _sets(spark, folder)
    return reduce(DataFrame.unionByName, [score.grade(expected, q, people, "id").withColumn("runner", F.lit(name)) for name, q in predicted.items()])


@query(SETS + ", m as (select runner, round(avg(f1), 6) f1 from sc group by runner) select runner, f1, row_number() over (order by f1 desc, runner) place from m")
def leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    return score.leaderboard(_runs(spark, folder).groupBy("runner").agg(F.round(F.avg("f1"), 6).alias("f1")))


@query(SETS + ", m as (select department, runner, round(avg(f1), 6) f1 from sc group by all) select department, runner, f1 from m qualify f1 = max(f1) over (partition by department) and f1 > 0")
def group_winners(spark: SparkSession, folder: str) -> DataFrame:
    """The runners with the best mean of each group, ties included, if above zero."""
    means = _runs(spark, folder).groupBy("department", "runner").agg(F.round(F.avg("f1"), 6).alias("f1"))
    best = means.groupBy("department").agg(F.max("f1").alias("best"))
    return means.join(best, "department").where("f1 = best and f1 > 0").select("department", "runner", "f1")


@query(SETS + """, m as (select department, avg(f1) filter (runner = 'at_later') o, avg(f1) filter (runner = 'at_then') q, avg(f1) filter (runner = 'mentions') b from sc group by department)
select department, round(o - q, 6) understanding, round(q - b, 6) reasoning, round(o - b, 6) total from m""")
def attribution_gaps(spark: SparkSession, folder: str) -> DataFrame:
    means = _runs(spark, folder).groupBy("department").pivot("runner", ["at_later", "at_then", "mentions"]).agg(F.avg("f1"))
    gap = lambda a, b: F.round(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)), 6)
    return means.select("department", gap("at_later", "at_then").alias("understanding"), gap("at_then", "mentions").alias("reasoning"), gap("at_later", "mentions").alias("total"))


@query(SETS + ", m as (select department, avg(f1) f1, count(*) n from sc where runner = 'at_then' group by department) select round(avg(f1), 6) mean_f1, round(stddev_pop(f1), 6) sd_f1, round(min(f1), 6) min_f1, round(max(f1), 6) max_f1, count(*) n_groups from m")
def scale_stats(spark: SparkSession, folder: str) -> DataFrame:
    means = _runs(spark, folder).where("runner = 'at_then'").groupBy("department").agg(F.avg("f1").alias("f1"))
    return means.agg(*[F.round(f("f1"), 6).alias(n) for n, f in (("mean_f1", F.avg), ("sd_f1", F.stddev_pop), ("min_f1", F.min), ("max_f1", F.max))], F.count(F.lit(1)).alias("n_groups"))


@query("""
, c as (select type, dst, count(distinct src) k from e where src is not null and dst is not null group by all)
select type, dst prediction, k from c qualify row_number() over (partition by type order by k desc, dst) = 1""")
def mode_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Per edge type the target named most often, ties to the smallest id."""
    edges = g.TemporalGraph.load(spark, folder).edges.where("src is not null and dst is not null")
    counts = edges.groupBy("type", "dst").agg(F.countDistinct("src").alias("k"))
    best = counts.groupBy("type").agg(F.min_by(F.struct("dst", "k"), F.struct(-F.col("k"), F.col("dst"))).alias("b"))
    return best.select("type", F.col("b.dst").alias("prediction"), F.col("b.k").alias("k"))


SUPPORT = PROV + """
, s as (select e.src, e.type, e.dst, count(*) support, count(distinct path) n_paths from pv join e on e.id = target_id where e.src is not null and e.dst is not null group by all)
"""


def _support(spark: SparkSession, folder: str) -> DataFrame:
    edges = g.TemporalGraph.load(spark, folder).edges.where("src is not null and dst is not null")
    return _provenance_pairs(spark, folder).join(edges.select(F.col("id").alias("target_id"), "src", "type", "dst"), "target_id").groupBy("src", "type", "dst").agg(F.count(F.lit(1)).alias("support"), F.countDistinct("path").alias("n_paths"))


@query(SUPPORT + "select src, type, dst, support, n_paths from s")
def edge_support(spark: SparkSession, folder: str) -> DataFrame:
    """Relations with the number of attestations and of distinct documents behind them."""
    return _support(spark, folder)


@query(SUPPORT + f""", gold as (select distinct src, type, dst from e where created <= timestamp '{LATER}' and src is not null and dst is not null), ng as (select count(*) n from gold),
t(threshold) as (values (1.0::double), (2.0::double), (3.0::double), (9.0::double)), k as (select threshold, count(src) b, count(*) filter (ok) c from t left join (select s.*, (src, type, dst) in (select (src, type, dst) from gold) ok from s) x on support >= threshold group by threshold)
select threshold, b n_predicted, c n_both, round(case when b = 0 then 0.0 else c / b end, 6) p, round(c / n, 6) r, round(case when c = 0 then 0.0 else 2.0 * c / (n + b) end, 6) f1 from k, ng""")
def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    t = g.TemporalGraph.load(spark, folder).at(LATER)
    gold = t.edges.where("src is not null and dst is not null").select("src", "type", "dst").distinct()
    scored = _support(spark, folder).join(gold.withColumn("ok", F.lit(True)), ["src", "type", "dst"], "left").select(F.col("support").cast("double").alias("score"), F.coalesce("ok", F.lit(False)).alias("right"))
    return rounded(score.sweep(scored, gold.agg(F.count(F.lit(1)).alias("n")), (1, 2, 3, 9)), "p", "r", "f1")


COMPARE = "select {g} \"{g}\", a n_expected, b n_predicted, c n_both, round(case when b = 0 then 0.0 else c / b end, 6) p, round(case when a = 0 then 0.0 else c / a end, 6) r, round(case when c = 0 then 0.0 else 2.0 * c / (a + b) end, 6) f1 from k"


@query(f", k as (select coalesce(x.type, y.type) \"type\", count(x.id) a, count(y.id) b, count(case when x.id = y.id then 1 end) c from n x full join (select id, type from n where created <= timestamp '{THEN}') y on x.id = y.id group by 1)" + COMPARE.format(g="type"))
def node_fidelity(spark: SparkSession, folder: str) -> DataFrame:
    t = g.TemporalGraph.load(spark, folder)
    return rounded(score.compare(t.nodes, t.at(THEN).nodes, ["id"], "type"), "p", "r", "f1")


@query(f""", x as (select distinct src, type, dst from e where src is not null and dst is not null), y as (select distinct src, type, dst from e where created <= timestamp '{THEN}' and src is not null and dst is not null),
k as (select coalesce(x.type, y.type) "type", count(x.src) a, count(y.src) b, count(case when x.src = y.src then 1 end) c from x full join y on x.src = y.src and x.dst = y.dst and x.type = y.type group by 1)""" + COMPARE.format(g="type"))
def edge_fidelity(spark: SparkSession, folder: str) -> DataFrame:
    t = g.TemporalGraph.load(spark, folder)
    triples = lambda x: x.edges.where("src is not null and dst is not null").select("src", "dst", F.col("type").alias("rel"), "type").distinct()
    return rounded(score.compare(triples(t), triples(t.at(THEN)), ["src", "dst", "rel"], "type"), "p", "r", "f1")


@query(PROV + """
, x as (select target_id id, path, n.type from pv join n on n.id = target_id), y as (select distinct entity_id id, artifact_path path, n.type from mentions join n on n.id = entity_id),
k as (select coalesce(x.type, y.type) "type", count(x.id) a, count(y.id) b, count(case when x.id = y.id then 1 end) c from x full join y on x.id = y.id and x.path = y.path group by 1)""" + COMPARE.format(g="type"))
def provenance_fidelity(spark: SparkSession, folder: str) -> DataFrame:
    kinds = g.TemporalGraph.load(spark, folder).nodes.select("id", "type")
    gold = _provenance_pairs(spark, folder).withColumnRenamed("target_id", "id").join(kinds, "id")
    said = read_table(spark, folder, "mentions").select(F.col("entity_id").alias("id"), F.col("artifact_path").alias("path")).where("path is not null").distinct().join(kinds, "id")
    return rounded(score.compare(gold, said, ["id", "path"], "type"), "p", "r", "f1")


ER = """
, gn as (select distinct type, lower(trim(f)) tok, id from n, unnest(list_concat([json_extract_string(props, '$.name')], coalesce(aliases, []))) t(f) where trim(f) <> ''),
rn as (select distinct type, lower(trim(f)) tok, id from recon_nodes, unnest(list_concat([json_extract_string(props, '$.label')], coalesce(aliases, []))) t(f) where trim(f) <> ''),
ex as (select n.id from n join recon_nodes r on r.id = n.id and r.type = n.type),
cand as (select distinct gn.type, rn.id other, gn.id gold from gn join rn on gn.type = rn.type and gn.tok = rn.tok where gn.id not in (select id from ex) and rn.id not in (select id from ex))
"""


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    forms = lambda df, key: df.select("type", "id", F.explode(F.concat(F.array(g.prop(key)), F.coalesce("aliases", F.array()))).alias("f")).where("trim(f) <> ''").select("type", F.lower(F.trim("f")).alias("tok"), "id").distinct()
    gold = forms(g.TemporalGraph.load(spark, folder).nodes, "name").withColumnRenamed("id", "gold")
    found = forms(read_table(spark, folder, "recon_nodes"), "label").withColumnRenamed("id", "other").join(gold, ["type", "tok"]).select("type", "other", "gold").distinct()
    # what has the same id and type on both sides is aligned already
    exact = read_table(spark, folder, "recon_nodes").select("id", "type").join(g.TemporalGraph.load(spark, folder).nodes.select("id", "type"), ["id", "type"]).select("id").distinct()
    return found.join(exact.withColumnRenamed("id", "other"), "other", "left_anti").join(exact.withColumnRenamed("id", "gold"), "gold", "left_anti").select("type", "other", "gold")


@query(ER + "select type, other, gold from cand")
def er_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _candidates(spark, folder)


@query(ER + "select 'over_merge' kind, count(*) n from (select other from cand group by other having count(distinct gold) > 1) union all select 'under_merge', count(*) from (select gold from cand group by gold having count(distinct other) > 1)")
def er_errors(spark: SparkSession, folder: str) -> DataFrame:
    c = _candidates(spark, folder)
    count = lambda by, of, kind: c.groupBy(by).agg(F.countDistinct(of).alias("k")).where("k > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("other", "gold", "over_merge").unionByName(count("gold", "other", "under_merge"))


def _aligned(spark: SparkSession, folder: str, ws: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The gold nodes, the records of the second source, and their alignment."""
    gold = ws.put(g.TemporalGraph.load(spark, folder).nodes.select("id", "type"), keep=True)
    other = ws.put(read_table(spark, folder, "recon_nodes").where("id is not null").select("id", "type").dropDuplicates(["id"]), keep=True)
    return gold, other, score.align_nodes(gold, other, ws.put(_candidates(spark, folder)), ws)


@query()
def greedy_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """One-to-one pairs of records and gold nodes: by id and type, then greedy in id order by name."""
    with Workspace(spark, "align") as ws:
        return _aligned(spark, folder, ws)[2].select("other", "gold")


@query()
def aligned_fidelity(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each gold type the second source holds once its records bear the ids of the nodes they are aligned with."""
    with Workspace(spark, "fidelity") as ws:
        gold, other, pairs = _aligned(spark, folder, ws)
        renamed = other.join(pairs.withColumnRenamed("other", "id"), "id", "left").select(F.coalesce("gold", "id").alias("id"), "type")
        return rounded(score.compare(gold.where("type in ('Person', 'Project', 'Initiative')"), renamed, ["id"], "type"), "p", "r", "f1")


# The questions asked, by what they ask about: (edge type or kind, qtype, difficulty, template).
DIRECT = (
    ("reports_to", "who", "easy", "Who does {} report to?"),
    ("leads", "what", "easy", "What team or department does {} lead?"),
    ("member_of", "what", "easy", "What teams and projects is {} a member of?"),
    ("owns", "what", "easy", "What goals does {} own?"),
    ("authored", "what", "medium", "What artifacts did {} author?"),
)
COUNTS = (
    ("member_of", "Team", "How many people are on {}?"),
    ("reports_to", "Person", "How many people report directly to {}?"),
    ("part_of", "Department", "How many teams are in {}?"),
)
CHAIN, DEPARTMENT, GROUNDED = "Who is in {}'s management chain, all the way up?", "Which department is {} in?", "Which artifacts mention or ground {}?"
ADVANCERS, SUBGOALS = "What advances the goal '{}', directly or through its subgoals?", "What are the subgoals of the goal '{}'?"

_q = lambda t: "'" + t.replace("'", "''") + "'"
_direct = " union all ".join(f"select '{e}' t, '{k}' qtype, '{d}' difficulty, {_q(t)} q" for e, k, d, t in DIRECT)
_counts = " union all ".join(f"select '{e}' t, '{k}' of, {_q(t)} q" for e, k, t in COUNTS)
QA = f"""
, lab as (select id, type, coalesce(nullif(aliases[1], ''), nullif(json_extract_string(props, '$.name'), ''), nullif(json_extract_string(props, '$.title'), ''), nullif(json_extract_string(props, '$.statement'), ''), id) l from n),
ed as (select distinct type, src, dst from e where src is not null and dst is not null),
al as (select distinct src, dst from ed where type = 'reports_to'), am as (select src, min(dst) dst from al group by src),
ar(a, b) as (select src, dst from am union select ar.a, am.dst from ar join am on am.src = ar.b),
an as (select src id, dst up from al where src <> dst union select ar.a, al.dst from ar join al on al.src = ar.b where ar.a <> al.dst),
sg(a, b) as (select src, dst from ed where type = 'subgoal_of' union select sg.a, ed.dst from sg join ed on ed.src = sg.b and ed.type = 'subgoal_of'),
tg as (select id goal, id dst from n where type = 'Goal' union select b, a from sg),
m(rt, qtype, difficulty, q, id, x) as (
 select 'direct_relation', qtype, difficulty, q, src, dst from ed join ({_direct}) d on d.t = ed.type
 union all select 'transitive', 'who', '', {_q(CHAIN)}, an.id, up from an join n using (id) where n.type = 'Person'
 union all select 'transitive', 'which', 'medium', {_q(DEPARTMENT)}, a.src, b.dst from ed a join ed b on b.src = a.dst join n p on p.id = a.src join n t on t.id = a.dst join n d on d.id = b.dst
   where a.type = 'member_of' and b.type = 'part_of' and p.type = 'Person' and t.type = 'Team' and d.type = 'Department'
 union all select 'provenance', 'which', 'medium', {_q(GROUNDED)}, entity_id, artifact_id from mentions join art on artifact_path = path
 union all select 'aggregation', 'count', 'medium', q, dst, src from ed join ({_counts}) c on c.t = ed.type join n on n.id = ed.dst and n.type = c.of
 union all select 'goal_tree', 'what', 'hard', {_q(ADVANCERS)}, goal, src from tg join ed using (dst) join n on n.id = goal and n.type = 'Goal' where ed.type = 'advances_goal'
 union all select 'goal_tree', 'what', 'medium', {_q(SUBGOALS)}, dst, src from ed join n on n.id = dst and n.type = 'Goal' where ed.type = 'subgoal_of'),
g as (select rt, qtype, any_value(difficulty) difficulty, q, id, list_sort(list(distinct x)) ids from m where x is not null group by rt, qtype, q, id),
z as (select rt, qtype, case when difficulty = '' then case when len(ids) > 1 then 'hard' else 'medium' end else difficulty end difficulty, replace(q, '{{}}', lab.l) question, ids from g join lab using (id))
select 'qa-' || substr(sha1(rt || chr(0) || qtype || chr(0) || question || chr(0) || list_aggregate(list_transform(ids, lambda i: i || chr(0)), 'string_agg', '')), 1, 12) id, rt reasoning_type, qtype, question, array_to_string(ids, '|') expected_ids,
 case when rt = 'aggregation' then len(ids)::varchar when rt <> 'provenance' and len(ids) = 1 then coalesce((select l from lab where lab.id = ids[1]), ids[1]) end expected_label, difficulty from z"""

@query(QA)
def qa_generate(spark: SparkSession, folder: str) -> DataFrame:
    """All questions over the graph in their fixed order: with expected ids, the label of a lone answer, and an id hashed from the content.

    Answers are gathered as long rows (question, asked about, answer) and made a sorted list once.
    """
    t = g.TemporalGraph.load(spark, folder)
    edges = t.edges.where("src is not null and dst is not null").select("type", "src", "dst").distinct()
    with Workspace(spark, "qa") as ws:
        edges = ws.put(edges, keep=True)
        nodes = ws.put(t.nodes.select("id", "type", g.question_label().alias("l")), keep=True)
        of = lambda kind: nodes.where(F.col("type") == kind).select("id")
        typed = lambda *kinds: edges.where(F.col("type").isin(*kinds))
        ask = lambda df, rt, qtype, difficulty, q, about, answer: df.select(F.lit(rt).alias("rt"), F.lit(qtype).alias("qtype"), F.lit(difficulty).alias("difficulty"), F.lit(q).alias("q"), F.col(about).alias("id"), F.col(answer).alias("x"))
        teams = typed("member_of").select("src", F.col("dst").alias("team")).join(of("Team").withColumnRenamed("id", "team"), "team", "left_semi")
        within = typed("part_of").select(F.col("src").alias("team"), "dst").join(of("Department").withColumnRenamed("id", "dst"), "dst", "left_semi")
        goals = of("Goal").withColumnRenamed("id", "goal")
        below = traverse.closure(typed("subgoal_of"), ws).select(F.col("b").alias("goal"), F.col("a").alias("dst"))
        targets = goals.select("goal", F.col("goal").alias("dst")).unionByName(below.join(goals, "goal", "left_semi")).distinct()
        said = g.groundings(read_table(spark, folder, "mentions"), t.nodes).select(F.col("entity_id").alias("id"), F.explode("artifacts").alias("x"))
        parts = [ask(typed(e), "direct_relation", k, d, q, "src", "dst") for e, k, d, q in DIRECT]
        parts += [ask(typed(e).join(of(k).withColumnRenamed("id", "dst"), "dst", "left_semi"), "aggregation", "count", "medium", q, "dst", "src") for e, k, q in COUNTS]
        parts += [
            ask(traverse.ancestors(typed("reports_to"), ws).join(of("Person"), "id", "left_semi"), "transitive", "who", "", CHAIN, "id", "ancestor"),
            ask(teams.join(of("Person").withColumnRenamed("id", "src"), "src", "left_semi").join(within, "team"), "transitive", "which", "medium", DEPARTMENT, "src", "dst"),
            ask(said, "provenance", "which", "medium", GROUNDED, "id", "x"),
            ask(typed("advances_goal").join(targets, "dst"), "goal_tree", "what", "hard", ADVANCERS, "goal", "src"),
            ask(typed("subgoal_of").join(goals.withColumnRenamed("goal", "dst"), "dst", "left_semi"), "goal_tree", "what", "medium", SUBGOALS, "dst", "src"),
        ]
        drafts = reduce(DataFrame.unionByName, parts).groupBy("rt", "qtype", "difficulty", "q", "id").agg(F.array_sort(F.collect_set("x")).alias("ids"))
        named = drafts.join(nodes.select("id", "l"), "id").withColumn("question", F.replace("q", F.lit("{}"), F.col("l")))
        lone = F.when((F.size("ids") == 1) & ~F.col("rt").isin("provenance", "aggregation"), F.col("ids")[0])
        labelled = named.drop("l").withColumn("lone", lone).join(nodes.select(F.col("id").alias("lone"), F.col("l").alias("lone_label")), "lone", "left")
        nul = F.lit("\x00")
        key = F.concat("rt", nul, "qtype", nul, "question", nul, F.array_join(F.transform("ids", lambda i: F.concat(i, nul)), ""))
        hard = F.when(F.col("difficulty") != "", F.col("difficulty")).otherwise(F.when(F.size("ids") > 1, "hard").otherwise("medium"))
        rows = labelled.orderBy("rt", "qtype", "question", "ids").select(
            F.concat(F.lit("qa-"), F.substring(F.sha1(key), 1, 12)).alias("id"), F.col("rt").alias("reasoning_type"), "qtype", "question", F.array_join("ids", "|").alias("expected_ids"),
            F.when(F.col("rt") == "aggregation", F.size("ids").cast("string")).otherwise(F.coalesce("lone_label", "lone")).alias("expected_label"), hard.alias("difficulty"),
        )
        return rows


@query("""
, r(a, b) as (select src, dst from e where type = 'reports_to' and src is not null and dst is not null union select r.a, e.dst from r join e on e.src = r.b where e.type = 'reports_to' and e.dst is not null),
c as (select a id, count(*) filter (a <> b) n from r group by a) select id, n, case when n > 1 then 'hard' else 'medium' end difficulty from c where n > 0""")
def qa_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Management chains as questions: their length decides how hard they are."""
    with Workspace(spark, "chains") as ws:
        pairs = traverse.closure(g.TemporalGraph.load(spark, folder).edges_of("reports_to"), ws)
        n = pairs.where("a <> b").groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        return n.withColumn("difficulty", F.when(F.col("n") > 1, "hard").otherwise("medium"))


@query("""
, g as (select id, type from n where type = 'Goal'), a as (select dst goal, string_agg(distinct src, '|' order by src) advancers, count(distinct src) n from e where type = 'advances_goal' and src is not null and dst in (select id from g) group by dst)
select goal, advancers, n from a""")
def goal_advancers(spark: SparkSession, folder: str) -> DataFrame:
    """Who advances each goal or one of its subgoals."""
    t = g.TemporalGraph.load(spark, folder)
    with Workspace(spark, "goals") as ws:
        below = traverse.closure(t.edges_of("subgoal_of"), ws).select(F.col("b").alias("goal"), F.col("a").alias("dst"))
        goals = t.of_type("Goal").select(F.col("id").alias("goal"))
        every = goals.select("goal", F.col("goal").alias("dst")).unionByName(below.join(goals, "goal", "left_semi"))
        pairs = t.edges_of("advances_goal").where("src is not null").join(every, "dst").select("goal", "src").distinct()
        return pairs.groupBy("goal").agg(F.array_join(F.array_sort(F.collect_set("src")), "|").alias("advancers"), F.count(F.lit(1)).alias("n"))
