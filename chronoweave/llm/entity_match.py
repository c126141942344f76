"""Matching entities across sources without keys: a deterministic cascade of exact joins on ever weaker attribute combinations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.runtime import Workspace, small

#: The cascade, strongest first. Every rule but the first is tried on what earlier rules left, and only a key that names one node resolves.
RULES = (
    "identifier",  # a person's mail handle, a project's code
    "desk+surname",
    "desk+first name",
    "date+name",
    "date+surname or place",
    "date+first name or acronym",
    "date+one letter off",
    "name+department",
    "name+site",
    "name",
    "name+identifier one letter off",  # the only one for a record whose identifier nobody bears
)
#: The rule by which the identifier itself is judged, and the one for identifiers that nobody bears.
DATE_NAME, MISSPELT = RULES.index("date+name"), RULES.index("name+identifier one letter off")
#: Labels that a spelling of the second source needs before it is learnt what the first calls it, and the share of them that must agree.
LEAST_LABELS, AGREEING = 2, 0.5

# Forms of address, which carry no identity, and the months as dates abbreviate them.
TITLES = "dr|prof|mr|mrs|ms|mx|sir|dame"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

NODE_PROPS = "name string, handle string, code string, desk string, hired_on string, started_on string, department string, site string"
RECON_PROPS = "label string, role string, dept string, contact struct<mail: string, desk: string>, since string, site string, code string"


def _date(c: Column) -> Column:
    """Year, month and day in figures from '2027-01-31', '2027/01/31', '31.01.2027' or 'Jan 31, 2027'; null for anything else."""
    month = F.floor((F.call_function("instr", F.lit(MONTHS), F.lower(F.substring(c, 1, 3))) + 2) / 3).cast("string")
    named = F.concat(F.right(c, F.lit(4)), F.lpad(month, 2, "0"), F.lpad(F.regexp_extract(c, r"(\d+),", 1), 2, "0"))
    return (
        F.when(c.rlike(r"^\d{4}[-/]\d\d[-/]\d\d"), F.translate(F.substring(c, 1, 10), "-/", "")).when(c.rlike(r"^\d\d\.\d\d\.\d{4}$"), F.concat(F.substring(c, 7, 4), F.substring(c, 4, 2), F.substring(c, 1, 2)))
        .when(c.rlike(r"^[A-Za-z]{3} \d{1,2}, \d{4}$") & (month != "0"), named)
    )


def _letters(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}]+", " "))


def _initials(words: Column) -> Column:
    """The initials of several words; a single short word may be initials itself."""
    parts = F.split(words, " ")
    return F.when(F.size(parts) > 1, F.array_join(F.transform(parts, lambda x: F.substring(x, 1, 1)), "")).when(F.length(words) <= 3, words)


def _clean(form: Column) -> Column:
    """Lower case, 'Surname, First' and 'Kind: rest' turned round, titles gone, hyphens closed up, letters only."""
    low = F.translate(F.lower(form), "-", "")
    turned = F.when(low.rlike("[,:]"), F.regexp_replace(low, r"^\s*([^,:]+)[,:]\s*(.+)$", "$2 $1")).otherwise(low)
    words = F.regexp_replace(turned, r"[^\p{L}]+", " ")
    return F.trim(F.regexp_replace(words, rf"\b(?:{TITLES})\b ?", ""))


def _one_off(word: Column) -> Column:
    """The word and all it becomes with one letter left out: two words share one if they are one edit or swap apart."""
    n = F.length(word)
    cuts = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.when(word.isNotNull(), F.array_distinct(F.concat(F.array(word), F.when(n > 3, cuts).otherwise(F.array().cast("array<string>")))))


def _tagged(rule: int) -> Callable[[Column], Column]:
    return lambda key: F.struct(F.lit(rule).alias("rule"), key.alias("key"))


def _exploded(rows: DataFrame, by_rule: dict[int, Column]) -> DataFrame:
    entries = F.concat(*[F.transform(F.coalesce(a, F.array().cast("array<string>")), _tagged(r)) for r, a in by_rule.items()])
    return rows.select("id", F.explode(entries).alias("e")).select("id", "e.*").where("key is not null")


def _keys(rows: DataFrame) -> DataFrame:
    """(id, rule, key) of rows with id, person, project, identifier, desk, date, department, initials, site, bare, clean (one row a form).

    Names alone are keys only where ``bare`` says that nothing stronger is given that could contradict them.
    """
    w = F.split(F.col("clean"), " ")
    first, last, n = w[0], F.element_at(w, -1), F.size(w)
    long_last = F.when(F.length(last) > 1, last)
    long_first = F.when((F.length(first) > 1) & (n > 1), first)
    full = F.when((n > 1) & (F.length(first) > 1) & (F.length(last) > 1), F.array_join(F.array_sort(F.filter(w, lambda x: F.length(x) > 1)), " "))
    acronym = F.when(n == 1, F.when(F.length(first) <= 4, first)).otherwise(F.array_join(F.transform(w, lambda x: F.substring(x, 1, 1)), ""))
    words = rows.select("*", first.alias("_first"), long_last.alias("_last"), long_first.alias("_long_first"), full.alias("_full"), acronym.alias("_acronym"))
    first, long_last, long_first, full, acronym = (F.col(c) for c in ("_first", "_last", "_long_first", "_full", "_acronym"))
    given = lambda cs: reduce(lambda a, b: a & b, [x.isNotNull() for x in cs])
    person = lambda *c: F.when(F.col("person") & given(c), F.concat_ws("|", F.lit("p"), *c))
    project = lambda *c: F.when(F.col("project") & given(c), F.concat_ws("|", F.lit("j"), *c))
    off = lambda word, head: F.coalesce(F.transform(_one_off(word), lambda x: F.concat_ws("|", *head, x)), F.array().cast("array<string>"))
    date, desk, ident = F.col("date"), F.nullif(F.col("desk"), F.lit("")), F.col("identifier")
    ends = [F.concat(F.lit("<"), F.left(ident, F.lit(3))), F.concat(F.lit(">"), F.right(ident, F.lit(3)))]  # one edit spares one end
    keys = _exploded(words, {
        1: F.array(person(desk, long_last)),
        2: F.array(person(desk, F.coalesce(long_first, long_last))),
        3: F.array(person(date, full), project(date, full)),
        4: F.array(person(date, long_last), project(date, F.when(F.length(first) > 3, first))),
        5: F.array(person(date, long_first), project(date, F.when(F.length(acronym) >= 2, acronym))),
        6: F.when(date.isNotNull(), F.concat(
            off(F.when(F.col("person"), long_last), (F.lit("p"), date, F.substring(first, 1, 1))),
            off(F.when(F.col("project") & (F.length(first) > 4), first), (F.lit("j"), date)),
        )),
        7: F.when(F.col("bare"), F.array(*[kind(full, d) for kind in (person, project) for d in (F.col("department"), F.col("initials"))])),
        8: F.when(F.col("bare"), F.array(person(full, F.col("site")))),
        9: F.when(F.col("bare"), F.array(person(full), project(full))),
        MISSPELT: F.array(*[kind(full, e) for kind in (person, project) for e in ends]),
    })
    return keys


def _figures(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _identifier(person: Column, mail: Column, code: Column) -> Column:
    """What one source alone would know the record by: 'p|' and a mail handle or 'j|' and the figures of a code; a mail goes first where both are given."""
    handle, figures = F.nullif(F.lower(F.split(mail, "@")[0]), F.lit("")), F.nullif(_figures(code), F.lit(""))
    return F.coalesce(F.when(F.coalesce(person, F.lit(True)), F.concat(F.lit("p|"), handle)), F.when(~F.coalesce(person, F.lit(False)), F.concat(F.lit("j|"), figures)))


def node_states(nodes: DataFrame) -> DataFrame:
    """One row per state of every person, project and initiative of the first source, with the forms of its name."""
    p = lambda k: F.col(f"p.{k}")
    mine = nodes.where(F.col("type").isin("Person", "Project", "Initiative") & F.col("id").isNotNull())
    mine = mine.select("id", (F.col("type") == "Person").alias("person"), F.from_json("props", NODE_PROPS).alias("p"), F.coalesce("aliases", F.array()).alias("aliases"))
    return mine.select(
        "id", "person", _identifier(F.col("person"), p("handle"), p("code")).alias("identifier"), F.right(_figures(p("desk")), F.lit(7)).alias("desk"),
        _date(F.coalesce(p("hired_on"), p("started_on"))).alias("date"), _letters(p("department")).alias("department"), F.lower(p("site")).alias("site"), F.concat(F.array(p("name")), "aliases").alias("forms"),
    )


def _form_rows(rows: DataFrame) -> DataFrame:
    """One row per distinct cleaned form. A record without a form that means anything has none."""
    each = rows.repartition("id").withColumn("form", F.explode(F.array_distinct("forms"))).drop("forms").where(F.trim("form") != "")
    return each.withColumn("clean", _clean(F.col("form"))).drop("form").distinct()  # in place, as the rows of an id lie together


def node_forms(states: DataFrame, aliases: DataFrame) -> DataFrame:
    """The keys' input of the first source: its states by form, those of the alias table included."""
    other = aliases.where("entity_id is not null").groupBy(F.col("entity_id").alias("id")).agg(F.array_distinct(F.flatten(F.collect_set(F.concat(F.array("canonical"), F.coalesce("aliases", F.array()))))).alias("more"))
    every = states.join(other, "id", "left").withColumn("forms", F.concat("forms", F.coalesce("more", F.array()))).drop("more")
    return _form_rows(every).withColumn("project", ~F.col("person")).withColumn("bare", F.lit(True)).withColumn("initials", _initials(F.col("department")))


def other_records(recon: DataFrame) -> DataFrame:
    """One row per record of the second source with what can be read without the first: ``kind`` is what its own type and properties leave open or decide."""
    p = lambda k: F.col(f"p.{k}")
    rows = recon.where("id is not null").select("id", "type", F.from_json("props", RECON_PROPS).alias("p"), F.coalesce("aliases", F.array()).alias("aliases"))
    person_like = p("contact").isNotNull() | p("role").isNotNull() | p("site").isNotNull()
    return rows.select(
        "id", "type", person_like.alias("person_like"), p("code").isNotNull().alias("coded"), _identifier(F.lit(None).cast("boolean"), p("contact.mail"), p("code")).alias("identifier"),
        F.right(_figures(p("contact.desk")), F.lit(7)).alias("desk"), _date(p("since")).alias("date"), _letters(p("dept")).alias("dept"), F.lower(p("site")).alias("site"), F.concat(F.array(p("label")), "aliases").alias("forms"),
    )


def _learnt(labels: DataFrame, theirs: str, ours: str) -> DataFrame:
    """(theirs, ours): what most labelled pairs with a spelling of the second source have in the first."""
    counts = labels.where(F.col(theirs).isNotNull() & F.col(ours).isNotNull()).groupBy(theirs, ours).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(theirs).agg(F.max_by(ours, F.struct("n", ours)).alias(ours), F.max("n").alias("most"), F.sum("n").alias("n"))
    return best.where((F.col("most") >= LEAST_LABELS) & (F.col("most") > AGREEING * F.col("n"))).select(theirs, ours)


def _one_node(hits: DataFrame) -> DataFrame:
    """(recon_id, rule, node_id) where all keys of a record that hit by a rule name one and the same node; the two ends of an identifier are judged apart."""
    end = F.when(F.col("rule") == MISSPELT, F.col("key")).alias("_end") if "key" in hits.columns else F.lit(None).cast("string").alias("_end")
    return hits.groupBy(F.col("id").alias("recon_id"), "rule", end).agg(F.min("lo").alias("node_id"), F.max("hi").alias("_hi")).where("node_id = _hi").drop("_hi", "_end")


def match(nodes: DataFrame, aliases: DataFrame, recon: DataFrame, workspace: Workspace) -> DataFrame:
    """(node_id, recon_id, rule, confidence, n_labels): at most one node for each record of the second source.

    Each pass takes the records still open whose keys of one rule name exactly one node and leaves them out of later passes. The
    first source is reduced to one row per key beforehand, so a name or date shared by any number of entities is one ambiguous
    row, never a product. All keys meet in one exact join; the passes run over its few resolved rows.

    A record whose identifier (a mail handle, a code) nobody in the first source bears names someone else, whatever name, desk or date
    it shares, unless that identifier is one letter off that of its one namesake with the same three letters at its beginning or end. Where the identifier is known but names several
    nodes, the first weaker rule that leaves one of these decides.

    Records resolved by identifier are the labels. From them is learnt what the second source calls a person or a department of the
    first, and how far each rule can be trusted: its confidence is (right + 1) / (``n_labels`` + 2) over the labelled
    records its key would have resolved; the identifier's own is the same figure for the agreement of dates.
    Null or blank names, null ids and broken props match nothing; repeated rows count once; empty tables give no rows.
    """
    states, records = workspace.put(node_states(nodes)), workspace.put(other_records(recon).distinct())
    bearers = workspace.put(states.where("identifier is not null").select("id", "identifier", "department", "person").distinct())
    known0 = bearers.groupBy("identifier").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    asked0 = records.where("identifier is not null").select("id", "identifier").distinct().join(known0, "identifier", "left").select("id", "identifier", F.lit(0).alias("rule"), "lo", "hi")
    asked0 = workspace.put(asked0)
    labelled = workspace.put(_one_node(asked0), keep=True)

    pairs = records.select(F.col("id").alias("recon_id"), "type", "dept").join(labelled, "recon_id").join(bearers.select(F.col("id").alias("node_id"), "department", F.col("person").cast("string").alias("kind")), "node_id")
    kinds, departments = (workspace.put(_learnt(pairs, *c)) for c in (("type", "kind"), ("dept", "department")))
    kind = F.when(F.col("type") == "Person", True).when(F.col("type").isin("Project", "Initiative"), False).otherwise(F.col("kind").cast("boolean"))
    forms = records.join(small(kinds), "type", "left").join(small(departments), "dept", "left")
    forms = forms.withColumns({"person": F.coalesce(kind, F.col("person_like") | ~F.col("coded")), "project": F.coalesce(~kind, ~F.col("person_like"))})
    forms = forms.withColumn("bare", F.col("date").isNull() & (F.coalesce("desk", F.lit("")) == "")).withColumn("initials", _initials(F.col("dept"))).drop("type", "kind", "person_like", "coded", "dept")
    asked = workspace.put(_keys(_form_rows(forms)).distinct())
    # nodes are numbered, so that the least and the greatest of a key are kept in a hash table instead of sorted text
    numbers = workspace.put(states.select("id").distinct().withColumn("number", F.monotonically_increasing_id()))
    node_rows = node_forms(states, aliases).join(small(numbers), "id").withColumn("id", F.col("number"))
    known = _keys(node_rows).groupBy("rule", "key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    hits = workspace.put(_one_node(asked.join(known, ["rule", "key"])).withColumnRenamed("node_id", "number").join(small(numbers.withColumnRenamed("id", "node_id")), "number").select("recon_id", "rule", "node_id"))
    spelt = hits.where(F.col("rule") == MISSPELT).join(asked0.select(F.col("id").alias("recon_id"), "identifier"), "recon_id").join(bearers.select(F.col("id").alias("node_id"), F.col("identifier").alias("theirs")), "node_id")
    near = spelt.where(F.levenshtein("identifier", "theirs", 1) >= 0).groupBy("recon_id", "rule").agg(F.min("node_id").alias("node_id"), F.max("node_id").alias("_hi"))
    hits = hits.where(F.col("rule") < MISSPELT).unionByName(near.where("node_id = _hi").drop("_hi"))
    label = F.when(F.col("label").isNotNull(), "labelled").when(F.col("bearer").isNotNull(), "torn").when(F.col("identified").isNotNull(), "stranger").otherwise("open")
    standing = asked0.groupBy(F.col("id").alias("recon_id")).agg(F.first(F.lit(True)).alias("identified"), F.max("lo").alias("bearer")).join(labelled.select("recon_id", F.col("node_id").alias("label")), "recon_id", "left")
    hits = workspace.put(hits.join(standing, "recon_id", "left").select("recon_id", "rule", "node_id", label.alias("standing"), "label"))

    found, left = [labelled.select("recon_id", "rule", "node_id")], hits.where(f"standing = 'open' and rule <> {MISSPELT} or standing = 'stranger' and rule = {MISSPELT}").select("recon_id", "rule", "node_id")
    for rule in range(1, len(RULES)):
        found.append(workspace.put(left.where(F.col("rule") == rule), keep=True))
        left = workspace.put(left.where(F.col("rule") > rule).join(found[-1].select("recon_id"), "recon_id", "left_anti")) if rule < len(RULES) - 1 else left
    # a known identifier that names several nodes: the weaker rules choose among its bearers, keyed by the identifier too
    torn = workspace.put(standing.where("bearer is not null and label is null").select(F.col("recon_id").alias("id")).join(asked.where(F.col("rule") < MISSPELT), "id").join(asked0.select("id", "identifier"), "id"))
    shared = workspace.put(bearers.select("id", "identifier").distinct().join(torn.select("identifier").distinct(), "identifier", "left_semi"))
    their_keys = _keys(node_forms(states.join(shared.select("id").distinct(), "id", "left_semi"), aliases)).where(F.col("rule") < MISSPELT).select("id", "rule", "key").distinct()
    theirs = shared.join(their_keys, "id")
    chosen = _one_node(torn.join(theirs.groupBy("identifier", "rule", "key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")), ["identifier", "rule", "key"]))
    first = chosen.groupBy("recon_id").agg(F.min(F.struct("rule", "node_id")).alias("x"))
    found.append(workspace.put(first.select("recon_id", "x.rule", "x.node_id"), keep=True))

    tried = hits.where("standing = 'labelled'").select("rule", (F.col("node_id") == F.col("label")).alias("right"))
    judged = tried.unionByName(tried.where(F.col("rule") == DATE_NAME).withColumn("rule", F.lit(0))).groupBy("rule").agg(F.count_if("right").alias("ok"), F.count(F.lit(1)).alias("n_labels"))
    precision = workspace.put(judged.select("rule", ((F.col("ok") + 1) / (F.col("n_labels") + 2)).alias("confidence"), "n_labels"), keep=True)
    names = F.create_map(*[F.lit(x) for i, r in enumerate(RULES) for x in (i, r)])
    all_found = reduce(DataFrame.unionByName, found).join(F.broadcast(precision), "rule", "left")  # one row a rule
    return all_found.select("node_id", "recon_id", names[F.col("rule")].alias("rule"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.coalesce("n_labels", F.lit(0)).alias("n_labels"))
