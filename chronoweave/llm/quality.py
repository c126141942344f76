"""Per-document text quality: statistics, exact per-language ranks, and outlier scores from their tail probabilities."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.runtime import Workspace, shuffle_partitions

# The closed word classes of each language (articles, pronouns, prepositions, conjunctions, auxiliaries, adverbs), the words any running sentence needs.
FUNCTION_WORDS = {
    "en": """a an the
        i you he she it we they me him her us them my your his its our their this that these those who whom whose which what somebody someone something anybody anyone anything
        nobody nothing everybody everyone everything each every all any some both no one
        about above across after against along among around at before behind below beside between beyond by down during for from in inside into near of off on onto out outside over
        past per since through throughout to toward under until up upon with within without
        and or but nor so yet if unless although though because as than while whereas when whenever where wherever whether lest once
        am is are was were be been being have has had having do does did can could may might must shall should will would not there then here how why""",
    "de": """der die das den dem des ein eine einen einem einer eines
        ich du er sie es wir ihr mich dich ihn uns euch mir dir ihm ihnen sich mein dein unser euer man jemand niemand nichts etwas dieser diese dieses diesen diesem jener jede jeder
        jedes alle welche welcher wer was ihre seine
        ab an auf aus bei bis durch für gegen hinter in mit nach neben ohne seit trotz über um unter von vor während wegen zu zwischen am im ins vom zum zur beim
        und oder aber sondern denn weil dass da wenn als ob obwohl damit sofern sobald bevor nachdem falls wie
        bin ist sind war waren sein habe hat haben hatte hatten werde wird werden wurde wurden worden kann können konnte muss müssen soll sollen sollte darf dürfen will wollen
        nicht nur noch auch schon so doch hier dort wo""",
    "fr": """le la les un une des du de au aux
        je tu il elle on nous vous ils elles me te se lui leur leurs en moi toi eux ce cet cette ces celui celle ceux cela qui que qu quoi dont où mon ma mes ton ta tes son sa ses notre
        nos votre vos rien personne aucun aucune chaque tout tous toute toutes
        à après avant avec chez contre dans depuis derrière dès devant entre hors malgré par parmi pendant pour sans sauf selon sous sur vers
        et ou mais donc or ni car si comme quand lorsque puisque quoique afin puis
        être est suis sommes sont était étaient été soit sera avoir ai avons avez ont avait avaient eu peut peuvent doit doivent va vont ne pas plus non ici là très bien encore toujours""",
    "es": """el la los las lo un una unos unas al del
        yo tú él ella usted nosotros ellos ellas me te se nos le les mi mis su sus nuestro nuestra este esta esto estos estas ese esa eso aquel que quien quienes cual cuyo alguien algo
        nadie nada cada todo toda todos todas otro otra
        a ante bajo con contra de desde durante en entre hacia hasta mediante para por según sin sobre tras
        y o ni pero sino aunque porque pues si como cuando donde mientras
        ser es son era eran fue fueron sido está están estaba haber ha han había hay puede pueden debe deben va van no más ya también muy tan antes después todavía""",
}
#: Shares that a unit of text needs to count as a running sentence.
LEAST_FUNCTION, MOST_DIGITS, LEAST_LETTERS, LEAST_DISTINCT, COPIES, LONG, SPACED = 0.10, 0.35, 0.70, 0.5, 3, 64, 12

_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_ALL = frozenset().union(*_SETS.values())
_DETERMINERS = frozenset("the an ein eine einen le les un une el los las una".split())
_NEVER_AFTER = frozenset("the an of and to is for has not with are will by at be was und ist für von mit zu sich wird et à est pour dans en avec sur y es con por del ein eine einen le les un une el los las una".split())
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_SYMBOL = re.compile(r"[\w\s]+")
_MARK = re.compile(r"\s*(?:[-*+•–—·]|\(?\d{1,3}[.)]|\d+(?:\.\d+)+)\s+")
_KEY_VALUE = re.compile(r"[\w.-]+\s*(?:=|:)\s*\S+$")
_STAMPED = re.compile(r"\d{4}-\d\d-\d\dT")
_CELLS = re.compile(r";\S[^;]*;|,\S[^,]*,\S[^,]*,|\S {3,}\S|<\S+@\S+>")
_HEAD = re.compile(r"\s*(?:#|(?:Subject|From|To|Cc|Date):)")
_BARS = re.compile(r"\s[»·/|>•–]\s")
_END = re.compile(r"[.!?…:][\"'”’)\]]*$")

STATS = ("n_words", "mean_word_length", "symbol_share", "end_punctuation_share", "common_word_share", "digit_share", "distinct_share", "order_share", "bare_stretch", "prose_share")
#: Which tail of a statistic speaks against prose. The share of running sentences has none: it is no part of the score, but the exact check that follows.
TAILS = {"mean_word_length": "both", "symbol_share": "high", "end_punctuation_share": "low", "common_word_share": "low", "digit_share": "high", "distinct_share": "low", "order_share": "low", "bare_stretch": "high"}
MEASURED = "doc_id bigint, lang_used string, " + ", ".join(f"{s} double" for s in STATS)


def _tabular(line: str) -> bool:
    """Whether a line is a row of a table, an export, a contact list or a table of contents."""
    if line.count("|") > 1 or "\t" in line or "....." in line:
        return True
    if (";" in line or "," in line or "   " in line or "@" in line) and _CELLS.search(line):
        return True
    return bool(_STAMPED.match(line) or (("=" in line or ":" in line) and _KEY_VALUE.match(line)))


def _running(unit: str, low: list[str], item: bool) -> bool:
    """Whether a unit (lines joined where they were wrapped) with words ``low`` reads as running sentences in normal word order."""
    words = unit.split()
    n, k = len(words), len(low)
    if n < 4 or k < 4:
        return False
    if n < (10 if item or _END.search(unit) is None else 4) and (item or n < 6 or len(unit) < LONG):
        return False
    letters = sum(map(len, low))
    if letters < LEAST_LETTERS * (len(unit) - n + 1) - 4 or n - k > MOST_DIGITS * n:
        return False
    if sum(map(_ALL.__contains__, low)) < LEAST_FUNCTION * k or len(_BARS.findall(unit)) > 2 + n // 12:
        return False
    # each distinct word but the last two begins a distinct triple, so the triples need counting only where words repeat
    if n >= 12 and len(set(low)) - 2 < LEAST_DISTINCT * (k - 2) and len(set(zip(low, low[1:], low[2:], strict=False))) < LEAST_DISTINCT * (k - 2):
        return False
    pairs = [b for a, b in zip(low, low[1:], strict=False) if a in _DETERMINERS]
    return len(pairs) < 4 or sum(map(_NEVER_AFTER.__contains__, pairs)) < 0.34 * len(pairs)


Unit = tuple[str, list[str], bool, int]


def units(text: str) -> tuple[list[Unit], list[str], int, int, int]:
    """Units (text, words, is a list item, characters) of the lines that could be sentences; all words; heading characters; lines, ended lines.

    Lines of one block are joined if nearly all were wrapped: the next line's first word would not have fitted on them.
    """
    out: list[Unit] = []
    block: list[Unit] = []
    every: list[str] = []
    heads = lines = ended = 0

    def close() -> None:
        if len(block) > 1:
            width = max(len(u[0]) for u in block)
            full = sum(len(u[0]) + 1 + len(v[0].split(None, 1)[0]) > width for u, v in zip(block, block[1:], strict=False))
            if full >= 0.8 * (len(block) - 1):
                out.append((" ".join(u[0] for u in block), [w for u in block for w in u[1]], False, sum(u[3] for u in block) + len(block) - 1))
                block.clear()
        out.extend(block)
        block.clear()

    for line in text.split("\n"):
        body = line.strip()
        if not body:
            close()
            continue
        lines += 1
        ended += _END.search(body[-4:]) is not None
        if body[0] in "|>" and body[1:2] == " " and "|" not in body[1:]:
            line = body = body[2:].strip()
        if body.count("\t") >= SPACED:
            line = body = " ".join(body.split())
        low = _WORD.findall(body.lower())
        every += low
        mark = _MARK.match(line)
        if mark:
            close()
            out.append((line[mark.end():].strip(), low, True, len(line)))
        elif _HEAD.match(body):
            close()
            heads += len(line)
        elif _tabular(body):
            close()
        else:
            block.append((body, low, False, len(line)))
    close()
    return out, every, heads, lines, ended


def measure(text: str, lang: str | None) -> tuple:
    """The language in use and STATS of one text; a text without words has zeros and share 1 of distinct and ordered pairs.

    ``bare_stretch`` is the longest run of words without a common one.
    """
    parts, low, heads, lines, ended = units(text)
    words = text.split()
    n = len(words)
    solid = len("".join(words)) or 1
    seen = Counter(low)
    marks = [-1, *[i for i, w in enumerate(low) if w in _ALL], len(low)]
    common = {w: seen[w] for w in seen.keys() & _ALL}
    votes = {k: sum(map(common.__getitem__, s & common.keys())) for k, s in _SETS.items()}
    best = max(votes, key=lambda k: votes[k])
    declared = (lang or "").lower().split("-")[0]
    used = best if votes[best] > votes.get(declared, 0) or declared not in votes else declared
    tri = len(low) - 2
    after = [b for a, b in zip(low, low[1:], strict=False) if a in _DETERMINERS]
    copies = Counter([u[0] for u in parts])
    running = sum(size for u, ws, item, size in parts if copies[u] <= COPIES and _running(u, ws, item))
    return (
        used, float(n), solid / n if n else 0.0, len(_SYMBOL.sub("", text)) / solid, ended / max(1, lines),
        sum(common.values()) / max(1, n), sum(map(len, _DIGITS.findall(text))) / solid,
        len(set(zip(low, low[1:], low[2:], strict=False))) / tri if tri > 0 else 1.0,
        1 - sum(map(_NEVER_AFTER.__contains__, after)) / len(after) if after else 1.0,
        float(max(map(int.__sub__, marks[1:], marks)) - 1 if low else n), min(1.0, running / max(1, len(text.strip()) - heads)),
    )


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), *[pa.float64()] * len(STATS), pa.int64()]
    names = ["doc_id", "lang_used", *STATS, "text_key"]
    known: dict[tuple[str, str | None], tuple] = {}
    for batch in batches:
        ids, texts, langs, text_keys = (batch.column(i).to_pylist() for i in range(4))
        rows = []
        for key in zip(texts, langs, strict=True):
            got = known.get(key)
            if got is None:
                if len(known) > 2000:
                    known.clear()
                got = known[key] = measure(*key)
            rows.append(got)
        columns = [ids, *map(list, zip(*rows, strict=True)), text_keys] if rows else [[] for _ in kinds]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def keyed_statistics(documents: DataFrame) -> DataFrame:
    """``statistics`` with text_key, equal for copies of a text."""
    return documents.where("trim(translate(text, '\\n\\t\\r', '   ')) <> ''").select(F.col("doc_id").cast("bigint"), "text", "lang", F.xxhash64("text").alias("text_key")).mapInArrow(_measure_batches, f"{MEASURED}, text_key bigint")


def statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, lang_used, STATS...) of every document with a non-blank text. One pass, no shuffle; whole texts.

    Null and blank texts have no row. A wrong or null lang is replaced by the language whose function words prevail.
    """
    return keyed_statistics(documents).drop("text_key")


def tails(measured: DataFrame, workspace: Workspace, stats: tuple[str, ...] = STATS) -> DataFrame:
    """(stat, lang_used, value, low_tail, high_tail, n_rows): exact empirical tail probabilities of every value within its language.

    Equal values are counted together first, so a value that a third of the rows share is one row. The distinct values
    are range-partitioned by (stat, language, value) and sorted; a value's rank is its place in its partition plus
    the offset of the partitions before it, which come from one small row per partition, statistic and language.
    """
    spark = measured.sparkSession
    values = workspace.put(_long(measured, stats).groupBy("stat", "lang_used", "value").agg(F.count(F.lit(1)).alias("n_rows")))
    ranged = workspace.put(values.repartitionByRange(shuffle_partitions(spark), "stat", "lang_used", "value").withColumn("pid", F.spark_partition_id()))
    before = Window.partitionBy("stat", "lang_used").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("stat", "lang_used")
    offsets = ranged.groupBy("stat", "lang_used", "pid").agg(F.sum("n_rows").alias("here")).select(
        "stat", "lang_used", "pid", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("offset"), F.sum("here").over(whole).alias("total")
    )
    place = Window.partitionBy("stat", "lang_used", "pid").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranged.withColumn("upto", F.sum("n_rows").over(place)).join(F.broadcast(offsets), ["stat", "lang_used", "pid"])
    rank = F.col("offset") + F.col("upto")
    return ranked.select("stat", "lang_used", "value", (rank / F.col("total")).alias("low_tail"), ((F.col("total") - rank + F.col("n_rows")) / F.col("total")).alias("high_tail"), "n_rows")


def _long(rows: DataFrame, stats: tuple[str, ...], *keys: str) -> DataFrame:
    return rows.select(*keys, "lang_used", F.expr("stack(%d, %s) as (stat, value)" % (len(stats), ", ".join(f"'{s}', {s}" for s in stats))))


def _salted(left: DataFrame, right: DataFrame, keys: list[str], met: str, spread: str) -> DataFrame:
    """``left`` joined with ``right``, which has each key once and in ``met`` the number of left rows that bear it.

    A key with more than a fair partition's rows is cut into pieces on both sides: by a hash of ``spread`` on the left, by
    as many copies of its one row on the right. At most two keys a partition are so many, as their rows are counted.
    """
    parts = shuffle_partitions(left.sparkSession)
    fair = right.agg(F.greatest(F.sum(met) / parts, F.lit(2000.0)).alias("fair"))
    pieces = right.crossJoin(F.broadcast(fair)).withColumn("pieces", F.least(F.ceil(F.col(met) / F.col("fair")), F.lit(parts)).cast("int"))
    copied = pieces.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("fair", "pieces", met)
    hot = F.broadcast(pieces.where("pieces > 1").select(*keys, "pieces"))
    salted = left.join(hot, keys, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("pieces")), F.lit(0)).cast("int")).drop("pieces")
    return salted.join(copied, [*keys, "salt"]).drop("salt")


def text_scores(measured: DataFrame, workspace: Workspace) -> DataFrame:
    """(text_key, lang_used, prose_share, copies, score) of each distinct text of ``measured`` (doc_id, lang_used, STATS, text_key).

    The score is the sum over the statistics of -ln of the tail that speaks against prose. Copies of a text count once in
    the ranks of their language, so a text isn't the norm by being repeated.
    """
    stats = tuple(TAILS)
    texts = workspace.put(measured.groupBy("text_key", "lang_used").agg(*[F.first(s).alias(s) for s in (*stats, "prose_share")], F.count(F.lit(1)).alias("copies")))
    by_value = tails(texts, workspace, stats)
    sides = {"low": F.col("low_tail"), "high": F.col("high_tail"), "both": F.least(F.lit(1.0), 2 * F.least("low_tail", "high_tail"))}
    part = F.lit(0.0)
    for stat, side in TAILS.items():
        part = F.when(F.col("stat") == stat, -F.log(sides[side])).otherwise(part)
    parts = workspace.put(by_value.select("stat", "lang_used", "value", part.alias("part"), "n_rows"))
    met = _salted(_long(texts, stats, "text_key"), parts, ["stat", "lang_used", "value"], "n_rows", "text_key")
    total = met.groupBy("text_key", "lang_used").agg(F.sum("part").alias("score"))
    return texts.select("text_key", "lang_used", "prose_share", "copies").join(total, ["text_key", "lang_used"])


def outlier_scores(measured: DataFrame, workspace: Workspace) -> DataFrame:
    """``measured`` with the score of its text."""
    scored = workspace.put(text_scores(measured, workspace).drop("prose_share"), keep=True)
    return _salted(measured, scored, ["text_key", "lang_used"], "copies", "doc_id").drop("text_key")


def least_scores(scored: DataFrame, least_share: float) -> DataFrame:
    """(lang_used, least): the score of the midmost of a language's texts that are running sentences by at least ``least_share``.

    Scores are counted to a thousandth, so that what is sorted per language are some ten thousand counts at most.
    """
    prose = scored.where(F.col("prose_share") >= least_share).groupBy("lang_used", F.round("score", 3).alias("least")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang_used").orderBy("least").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    half = prose.withColumn("upto", upto).withColumn("half", F.sum("n").over(Window.partitionBy("lang_used")) / 2)
    return half.where("upto >= half").groupBy("lang_used").agg(F.min("least").alias("least"))


def no_prose(documents: DataFrame, workspace: Workspace, least_share: float = 0.5) -> DataFrame:
    """Outliers that are no natural prose: the score decides who is one, an exact count of the characters in running sentences confirms it.

    A document is an outlier if it is at least as unusual as the midmost prose text of its language (``least_scores``). The bound
    moves with the language's own prose, so it holds however common junk is; a language without any prose has no bound. What is
    less unusual than half of all prose is a short or plain text, whatever the exact check makes of it.
    """
    measured = workspace.put(keyed_statistics(documents), keep=True)
    scored = workspace.put(text_scores(measured, workspace))
    least = F.broadcast(least_scores(scored, least_share))  # one row a language
    unusual = scored.join(least, "lang_used", "left").where("least is null or round(score, 3) >= least").drop("least")
    found = workspace.put(unusual.where(F.col("prose_share") < least_share).select("text_key", "lang_used", "copies", "score"), keep=True)
    return _salted(measured, found, ["text_key", "lang_used"], "copies", "doc_id").drop("text_key")
