"""Building a graph from extracted mentions and triples, and projecting its groundings."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from chronoweave.functions.stable import confidence
from chronoweave.operators import surfaces
from chronoweave.operators.graph import artifacts_by_path
from chronoweave.operators.text import normalized
from chronoweave.runtime import small

ENVELOPE = "struct<mentions: array<struct<surface_form: string, type: string>>, triples: array<struct<src: string, rel: string, dst: string, confidence: string>>>"


def mention_spans(envelopes: DataFrame, chunks: DataFrame, types: Sequence[str]) -> DataFrame:
    """(chunk_id, surface_form, type, start, stop): extracted mentions of known types, located in their chunk, -1 if they do not occur."""
    rows = envelopes.select("chunk_id", F.explode(F.from_json("body", ENVELOPE)["mentions"]).alias("m")).select("chunk_id", "m.*").where(F.trim("surface_form") != "")
    kept = rows.where(F.col("type").isin(*types)).dropDuplicates(["chunk_id", "surface_form", "type"]).join(chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id", "left")
    at = F.coalesce(F.call_function("instr", F.col("text"), F.col("surface_form")) - 1, F.lit(-1))
    return kept.withColumn("start", at).select("chunk_id", "surface_form", "type", "start", F.when(at >= 0, at + F.length("surface_form")).otherwise(-1).alias("stop"))


def candidate_triples(envelopes: DataFrame, relations: Sequence[str]) -> DataFrame:
    """(chunk_id, src, rel, dst, confidence) of relations in the vocabulary."""
    rows = envelopes.select("chunk_id", F.explode(F.from_json("body", ENVELOPE)["triples"]).alias("t")).select("chunk_id", "t.*")
    return rows.where(F.col("rel").isin(*relations)).withColumn("confidence", confidence(F.col("confidence")))


def resolve_triples(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Both ends by (chunk, normalized surface), the smallest entity where several claim it; self-loops and open ends are left out.

    ``entities`` has chunk_id, surface_form and entity_id.
    """
    known = entities.groupBy("chunk_id", normalized(F.col("surface_form")).alias("form")).agg(F.min("entity_id").alias("entity_id"))
    end = lambda c: known.select("chunk_id", F.col("form").alias(f"{c}_form"), F.col("entity_id").alias(f"{c}_id"))
    named = triples.withColumn("src_form", normalized(F.col("src"))).withColumn("dst_form", normalized(F.col("dst")))
    return named.join(end("src"), ["chunk_id", "src_form"]).join(end("dst"), ["chunk_id", "dst_form"]).where("src_id <> dst_id").select("chunk_id", F.col("src_id").alias("src"), "rel", F.col("dst_id").alias("dst"), "confidence")


def edges(resolved: DataFrame, chunks: DataFrame, least: float = 0.0) -> DataFrame:
    """One edge per (src, rel, dst): support counts triples, confidence is the best, with the sorted chunks and paths behind it."""
    paths = chunks.select(F.col("id").alias("chunk_id"), "source_path").distinct()
    rows = resolved.join(paths, "chunk_id", "left").groupBy("src", "rel", "dst").agg(
        F.count(F.lit(1)).alias("support"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.array_sort(F.collect_set("source_path")).alias("source_paths")
    )
    return rows.where(F.col("confidence") >= least).withColumn("id", F.concat_ws(":", F.lit("edge"), "rel", "src", "dst"))


def node_provenance(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    paths = chunks.select(F.col("id").alias("chunk_id"), "source_path").distinct()
    return entities.join(paths, "chunk_id", "left").groupBy("entity_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.array_sort(F.collect_set("source_path")).alias("source_paths"))


def project_groundings(grounded: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity_id, artifact) and the artifacts that had to be made up: a path is its artifact's id where one is known, else itself."""
    pairs = grounded.select("entity_id", F.explode("source_paths").alias("path")).distinct().join(artifacts_by_path(nodes), "path", "left")
    made = pairs.where("artifact_id is null").select(F.col("path").alias("id"), F.lit("Artifact").alias("type"), "path").distinct()
    return pairs.select("entity_id", F.coalesce("artifact_id", "path").alias("artifact")).distinct(), made


def resolve_aliases(questions: DataFrame, index: DataFrame, held: int = surfaces.HELD_PAIRS) -> DataFrame:
    """(id, entity_id): entities whose surface stands in the text, word-bounded, leftmost and longest first, none overlapping. A question has one row.

    Up to ``held`` pairs (and ``HELD_SURFACES`` surfaces) are sent to every worker, which reads each text once from left to right, so that neither texts
    nor results are shuffled. Of more, candidates come from a join on the surfaces' first words, and claims are made by a fold over a text's own
    sorted candidates. An ambiguous surface gives all its entities.
    """
    low = F.lower("text")
    forms = index.select(F.lower("surface").alias("surface"), "entity_id").where("trim(surface) <> '' and entity_id is not null").distinct()
    table = forms.limit(held + 1).toArrow()
    if table.num_rows <= held:
        codes = [table[c].combine_chunks().dictionary_encode() for c in ("surface", "entity_id")]
        if len(codes[0].dictionary) <= surfaces.HELD_SURFACES:
            return _resolve_held(questions.where("text is not null").select("id", low.alias("t")), *codes)
    # a surface without a word has the word '', as every text has
    words = questions.select("id", F.explode(F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(r"(?U)\w+"), F.lit(0)), F.array(F.lit(""))))).alias("word"))
    worded = forms.select("surface", F.regexp_extract("surface", r"(?U)\w+", 0).alias("word")).distinct()
    near = words.join(small(worded), "word").join(questions.select("id", low.alias("t")), "id")
    # cut where the surface begins, so that one that overlaps itself is found at each of its places; the blank keeps the first part
    pattern = F.concat(F.lit(r"(?U)(?<!\w)(?=\Q"), F.replace("surface", F.lit(r"\E"), F.lit("")), F.lit(r"\E(?!\w))"))
    parts = near.select("id", "surface", F.split(F.concat(F.lit(" "), "t"), pattern).alias("p")).where(F.size("p") > 1)
    lengths = lambda i: F.aggregate(F.slice("p", F.lit(1), i + 1), F.lit(-1), lambda a, x: a + F.length(x))
    here = parts.select("id", "surface", F.explode(F.transform(F.sequence(F.lit(0), F.size("p") - 2), lengths)).alias("at"))
    spans = here.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("at", (-F.length("surface")).alias("l"), "surface"))).alias("spans"))
    fold = F.aggregate(
        "spans", F.struct(F.lit(0).alias("stop"), F.array().cast("array<string>").alias("kept")),
        lambda a, s: F.when(s["at"] >= a["stop"], F.struct((s["at"] - s["l"]).alias("stop"), F.concat(a["kept"], F.array(s["surface"])).alias("kept"))).otherwise(a), lambda a: a["kept"],
    )
    return spans.select("id", F.explode(fold).alias("surface")).join(forms, "surface").select("id", "entity_id").distinct()


def _resolve_held(questions: DataFrame, known: pa.DictionaryArray, entities: pa.DictionaryArray) -> DataFrame:
    """``known`` and ``entities`` are the two sides of the pairs, each pair once."""
    surface, entity = (x.indices.to_numpy(zero_copy_only=False).astype(np.int32) for x in (known, entities))
    first = np.append(0, np.cumsum(np.bincount(surface, minlength=len(known.dictionary))))
    held = surfaces.odd(), known.dictionary, first, entity[np.argsort(surface, kind="stable")], entities.dictionary
    shared, key = questions.sparkSession.sparkContext.broadcast(held), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claims = surfaces.claims(key, shared)
        _, _, first, entity, names = shared.value
        for batch in batches:
            ids = batch.column(0)

            def pairs(rows: list[int], found: list[np.ndarray], ids: pa.Array = ids) -> pa.RecordBatch:
                at = np.repeat(np.array(rows, np.int32), [len(x) for x in found])
                return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), names.take(pa.array(np.concatenate(found)))], ["id", "entity_id"])

            rows, found, n = [], [], 0
            for i, t in enumerate(batch.column(1).to_pylist()):
                if kept := [entity[first[k] : first[k + 1]] for k in claims.of(t)]:
                    rows.append(i)
                    found.append(kept[0] if len(kept) == 1 else np.unique(np.concatenate(kept)))
                    n += len(found[-1])
                    if n >= surfaces.CLAIMED_ROWS:
                        yield pairs(rows, found)
                        rows, found, n = [], [], 0
            if rows:
                yield pairs(rows, found)

    return questions.mapInArrow(run, StructType([questions.schema["id"], StructField("entity_id", StringType())]))


def snippets(mentions: DataFrame, texts: DataFrame) -> DataFrame:
    """Mentions with the line of their artifact they stand on; null where artifact or line is not there. ``texts`` has path and text."""
    lines = texts.select(F.col("path").alias("artifact_path"), F.split("text", "\n").alias("lines"))
    line = F.greatest(F.coalesce("locator.line", F.lit(1)), F.lit(1))
    return mentions.join(lines, "artifact_path", "left").select("artifact_path", "entity_id", "surface_form", line.alias("line"), F.get("lines", line - 1).alias("snippet"))
