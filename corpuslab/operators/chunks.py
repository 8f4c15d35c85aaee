"""Sentences, chunks and frames. All row-local: a document's text is cut inside its row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.plans.scale import compute_once


def sentence_rows(docs: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    return docs.select(*keys, F.posexplode(tx.sentences(F.col(text))).alias("sent_pos", "sentence"))


def word_chunk_rows(docs: DataFrame, keys: Sequence[str], text: str, size: int) -> DataFrame:
    return compute_once(docs, _w=tx.words(F.col(text))).select(
        *keys, F.posexplode(tx.word_chunks(F.col("_w"), size)).alias("chunk_pos", "chunk")
    )


def ngram_rows(docs: DataFrame, keys: Sequence[str], text: str, n: int) -> DataFrame:
    return compute_once(docs, _w=tx.words(F.col(text))).select(
        *keys, F.posexplode(tx.ngrams(F.col("_w"), n)).alias("pos", "ngram")
    )


def _spans(items: Column, limit: int) -> Column:
    """Greedy packing over array<struct<words, cost>>: array<struct<start, length>> of the
    chunks, carried in the fold so that nothing is evaluated per chunk."""
    indexed = F.transform(
        items, lambda x, i: F.struct(i.alias("i"), x["words"].alias("words"), x["cost"].alias("cost"))
    )
    empty = F.struct(
        F.array().cast("array<struct<start:int,length:int>>").alias("done"),
        F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(-1).alias("last"),
    )

    def span(start: Column, end: Column) -> Column:
        return F.array(F.struct(start.alias("start"), (end - start).alias("length")))

    def step(acc: Column, x: Column) -> Column:
        stays = (x["i"] == 0) | (acc["n"] + x["cost"] <= limit)
        return F.struct(
            F.when(stays, acc["done"]).otherwise(F.concat(acc["done"], span(acc["start"], x["i"]))).alias("done"),
            F.when(stays, acc["start"]).otherwise(x["i"]).alias("start"),
            F.when(stays, acc["n"] + x["words"]).otherwise(x["words"]).alias("n"),
            x["i"].alias("last"),
        )

    def close(acc: Column) -> Column:
        tail = F.concat(acc["done"], span(acc["start"], acc["last"] + 1))
        return F.when(acc["last"] >= 0, tail).otherwise(acc["done"])

    return F.aggregate(indexed, empty, step, close)


def pack_sentences(
    docs: DataFrame, keys: Sequence[str], text: str, limit: int = 32, costs: str | None = None
) -> DataFrame:
    """Greedy sentence packing: a sentence joins the chunk while words so far plus its cost
    stay within ``limit``. ``costs`` names an array<int> column aligned with the sentences
    (for example subword counts); by default a sentence costs its words."""
    base = compute_once(docs, _s=tx.sentences(F.col(text)))
    base = compute_once(base, _n=F.transform("_s", lambda s: F.size(tx.words(s))))
    cost = F.col(costs) if costs else F.col("_n")
    items = F.zip_with("_n", cost, lambda w, c: F.struct(w.alias("words"), c.alias("cost")))
    cut = lambda at: tx.strip_space(F.array_join(_part("_s", at), " "))
    return compute_once(base, _at=_spans(items, limit)).select(
        *keys, F.posexplode(F.transform("_at", cut)).alias("chunk_pos", "chunk")
    )


def _part(values: str, at: Column) -> Column:
    return F.slice(values, at["start"] + 1, at["length"])


def pack_with_frames(
    docs: DataFrame, keys: Sequence[str], annotated: str, limit: int = 512
) -> DataFrame:
    """Greedy packing of array<struct<sentence, frames>>; sentences without frames are
    skipped and every chunk carries the words of its sentences' frames."""
    base = compute_once(docs, _s=F.filter(annotated, lambda s: F.size(s["frames"]) > 0))
    base = compute_once(base, _n=F.transform("_s", lambda s: F.size(tx.words(s["sentence"]))))
    items = F.transform("_n", lambda w: F.struct(w.alias("words"), w.alias("cost")))
    spans = compute_once(base, _at=_spans(items, limit))
    return spans.select(*keys, F.posexplode(F.transform("_at", lambda at: _part("_s", at))).alias("chunk_pos", "_c")).select(
        *keys,
        "chunk_pos",
        tx.strip_space(F.array_join("_c.sentence", " ")).alias("chunk"),
        F.array_join(F.transform(F.flatten("_c.frames"), tx.frame_words), " ").alias("frame_text"),
    )


def sentence_frames(annotations: DataFrame, key: str) -> DataFrame:
    """One row per document: its frames in order, array<struct<sent_pos, frame_pos, frame>>.

    annotations: (key, sent_pos, frame_pos, frame). One shuffle by document and one gathering, bounded by the
    document's own length.
    """
    return annotations.repartition(key).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("sent_pos", "frame_pos", "frame"))).alias("sent_frames"))


def annotate_sentences(docs: DataFrame, annotations: DataFrame, key: str, text: str) -> DataFrame:
    """Adds annotated: array<struct<sentence, frames>>, a sentence without annotation
    keeping an empty list and empty sentences dropped. Frames are cut into one list per sentence in a pass
    along them, so the time of a document grows with its length."""
    # both sides are placed by document, so the merge join adds no shuffle
    frames = sentence_frames(annotations, key).hint("merge")
    base = compute_once(docs.repartition(key).join(frames, key, "left"), _s=tx.sentences(F.col(text)))
    inside = F.filter("sent_frames", lambda f: (f["sent_pos"] >= 0) & (f["sent_pos"] < F.size("_s")))
    base = compute_once(base, _f=F.coalesce(inside, F.array().cast(frames.schema["sent_frames"].dataType)))
    at = lambda i: F.get("_f", i)["sent_pos"]
    base = compute_once(base, _b=F.filter(F.transform("_f", lambda f, i: i), lambda i: (i == 0) | (at(i) != at(i - 1))))
    none = F.array().cast("array<string>")

    def own(b: Column, i: Column) -> Column:
        """Empty lists of the sentences before that have no frame, and the list of this one."""
        gap = at(b) - F.coalesce(at(F.get("_b", i - 1)), F.lit(-1)) - 1
        run = F.slice("_f", b + 1, F.coalesce(F.get("_b", i + 1), F.size("_f")) - b)
        return F.concat(F.array_repeat(none, gap.cast("int")), F.array(F.transform(run, lambda f: f["frame"])))

    base = compute_once(base, _l=F.flatten(F.transform("_b", own)))
    paired = F.transform("_s", lambda s, i: F.struct(s.alias("sentence"), F.coalesce(F.get("_l", i), none).alias("frames")))
    return base.withColumn("annotated", F.filter(paired, lambda s: F.length(s["sentence"]) > 0)).drop("sent_frames", "_s", "_f", "_b", "_l")
