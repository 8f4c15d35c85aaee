"""Text, sentence and chunk queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.catalog import standins as st
from corpuslab.functions import text as tx
from corpuslab.operators import chunks, lexicon, subwords, tagging
from corpuslab.plans.scale import cut_lineage

# SQL pieces
SENTS = (
    "SELECT doc_id, lang, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sent_pos FROM ("
    "SELECT doc_id, lang, string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS s"
    " FROM documents)"
)
WORDS = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"
STOP = (
    "SELECT word FROM (SELECT word, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest("
    + WORDS.format("lower(text)") + ") AS word FROM documents) GROUP BY word) ORDER BY df DESC, word LIMIT 20"
)


def bracket_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = st.wide_documents(spark, sf_dir)
    return docs.select("doc_id", tx.normalise(F.col("text")).alias("clean"))


def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = st.wide_documents(spark, sf_dir)
    return docs.select("doc_id", tx.normalise(F.col("text"), brackets=False, noise=st.NOISE_WORDS).alias("clean"))


def alpha_stop_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop = [row.word for row in st.top_words(spark, sf_dir, 20).collect()]
    tokens = tx.keep_alphabetic(tx.drop_stop_words(tx.words(F.lower("text")), stop))
    docs = st.wide_documents(spark, sf_dir).withColumn("kept", tokens)
    return docs.select("doc_id", F.size("kept").cast("long").alias("n_kept"), F.array_join("kept", " ").alias("clean"))


def lexicon_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = st.wide_documents(spark, sf_dir).select("doc_id", tx.words(F.lower("text")).alias("tokens"))
    return lexicon.lemmatise(docs, "doc_id", "tokens", st.lexicon(spark, sf_dir))


def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = st.wide_documents(spark, sf_dir).select("doc_id", tx.terms(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("digest"))


def whitespace_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = st.wide_documents(spark, sf_dir).select("doc_id", tx.words(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_words"), F.md5(F.array_join("t", " ")).alias("digest"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.sentence_rows(st.wide_documents(spark, sf_dir), ["doc_id"], "text")
    return rows.withColumn("sent_pos", F.col("sent_pos").cast("long"))


def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.word_chunk_rows(st.wide_documents(spark, sf_dir), ["doc_id", "label"], "text", 500)
    return rows.withColumn("chunk_pos", F.col("chunk_pos").cast("long"))


def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = st.wide_documents(spark, sf_dir).withColumn("w", tx.words(F.col("text")))
    each = [
        F.struct(
            F.lit(n).cast("long").alias("n"), F.size(tx.ngrams(F.col("w"), n)).cast("long").alias("n_grams"),
            F.md5(F.array_join(tx.ngrams(F.col("w"), n), "|")).alias("digest"),
        )
        for n in (1, 2, 3)
    ]
    return docs.select("doc_id", F.explode(F.array(*each)).alias("g")).select("doc_id", "g.*")


def sentence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.pack_sentences(st.wide_documents(spark, sf_dir), ["doc_id", "label"], "text", 32)
    return rows.withColumn("chunk_pos", F.col("chunk_pos").cast("long"))


def context_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of all sentences; the first sentence of every document is the labelled table, where a word's tag depends
    on its length and, for most words, on its place."""
    docs = st.wide_documents(spark, sf_dir)
    sents = docs.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("sent_pos", "s"))
    tokens = cut_lineage(sents.select("doc_id", "sent_pos", F.posexplode(tx.words(F.col("s"))).alias("pos", "word")))
    rest = F.length("word") % 5
    tag = F.when(rest == 0, "ADV").when(rest == 1, "NUM").when(F.col("pos") % 2 == 1, "VERB").otherwise("NOUN")
    model = tagging.fit(tokens.filter("sent_pos = 0").withColumn("tag", tag), ["doc_id"])
    rows = tagging.tag(tokens, ["doc_id", "sent_pos"], model)
    return rows.select("doc_id", F.col("sent_pos").cast("long").alias("sent_pos"), F.array_join("tags", " ").alias("tags"))


def _pieces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Distinct words, and pieces taken from them: first characters, first three, last one and last two."""
    words = st.wide_documents(spark, sf_dir).select(F.explode(tx.words(F.col("text"))).alias("word")).distinct()
    words = cut_lineage(words)
    cuts = F.array(
        F.substring("word", 1, 1), F.substring("word", 1, 3), F.concat(F.lit("##"), F.substring("word", -1, 1)),
        F.concat(F.lit("##"), F.substring("word", -2, 2)))
    return words, words.select(F.explode(cuts).alias("piece")).distinct()


def subword_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces per distinct word by longest match."""
    return subwords.word_costs(*_pieces(spark, sf_dir)).select("word", F.col("cost").cast("long").alias("cost"))


def subword_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences packed by the pieces that the next one would add."""
    costs = subwords.word_costs(*_pieces(spark, sf_dir))
    docs = subwords.sentence_costs(st.wide_documents(spark, sf_dir), "doc_id", "text", costs)
    rows = chunks.pack_sentences(docs, ["doc_id"], "text", 64, "costs")
    return rows.withColumn("chunk_pos", F.col("chunk_pos").cast("long"))


def sentence_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, notes = st.documents(spark, sf_dir), st.annotations(spark, sf_dir)
    rows = chunks.annotate_sentences(docs, notes, "doc_id", "text")
    return rows.select("doc_id", F.posexplode("annotated").alias("sent_pos", "a")).select(
        "doc_id", F.col("sent_pos").cast("long").alias("sent_pos"), F.array_join("a.frames", " ").alias("frames")
    )


def frame_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, notes = st.documents(spark, sf_dir), st.annotations(spark, sf_dir)
    rows = chunks.pack_with_frames(
        chunks.annotate_sentences(docs, notes, "doc_id", "text"), ["doc_id"], "annotated", 512
    )
    return rows.withColumn("chunk_pos", F.col("chunk_pos").cast("long"))


def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.word_chunk_rows(st.wide_documents(spark, sf_dir), ["doc_id", "label"], "text", 32)
    return rows.select(
        "doc_id", F.col("chunk_pos").cast("long").alias("chunk_pos"),
        tx.render_prompt(F.col("chunk"), F.col("label")).alias("prompt"),
    )


def answer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers read back from each document's prompts and from its raw text (which has none)."""
    rendered = prompt_render(spark, sf_dir).select("doc_id", "chunk_pos", tx.extract_answer(F.col("prompt")).alias("answer"))
    raw = st.wide_documents(spark, sf_dir).select(
        "doc_id", F.lit(-1).cast("long").alias("chunk_pos"), tx.extract_answer(F.col("text")).alias("answer")
    )
    return rendered.unionByName(raw)


def _packed_sql(source: str, limit: int) -> str:
    """Recursive greedy packing: one step per sentence index over all documents."""
    return f"""
WITH RECURSIVE s AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sent_pos) - 1 AS i, sentence, frames,
         len({WORDS.format('sentence')}) AS w
  FROM ({source})
), p AS (
  SELECT doc_id, i, 0::BIGINT AS chunk_pos, w AS n FROM s WHERE i = 0
  UNION ALL
  SELECT s.doc_id, s.i, CASE WHEN p.n + s.w <= {limit} THEN p.chunk_pos ELSE p.chunk_pos + 1 END,
         CASE WHEN p.n + s.w <= {limit} THEN p.n + s.w ELSE s.w END
  FROM p JOIN s ON s.doc_id = p.doc_id AND s.i = p.i + 1
)
SELECT p.doc_id, p.chunk_pos, trim(string_agg(s.sentence, ' ' ORDER BY s.i), E' \\n\\t') AS chunk,
       string_agg(s.frames, ' ' ORDER BY s.i) AS frame_text
FROM p JOIN s ON s.doc_id = p.doc_id AND s.i = p.i GROUP BY p.doc_id, p.chunk_pos
"""


SUBWORDS = f"""w AS MATERIALIZED (SELECT DISTINCT unnest({WORDS.format('text')}) AS word FROM documents),
pieces AS (SELECT word[1:1] AS piece FROM w UNION SELECT word[1:3] FROM w UNION SELECT '##' || right(word, 1) FROM w UNION SELECT '##' || right(word, 2) FROM w),
cut AS (
  SELECT word, 0 AS pos, 0 AS n FROM w WHERE length(word) <= 100
  UNION ALL
  SELECT c.word, c.pos + max(k), c.n + 1 FROM cut c JOIN (SELECT unnest([1, 2, 3]) AS k) ON c.pos + k <= length(c.word)
  JOIN pieces ON piece = CASE WHEN c.pos > 0 THEN '##' ELSE '' END || substring(c.word, c.pos + 1, k) GROUP BY c.word, c.pos, c.n),
costs AS MATERIALIZED (SELECT w.word, coalesce(max(n) FILTER (pos = length(w.word)), 1) AS cost FROM w LEFT JOIN cut USING (word) GROUP BY w.word)"""
_COSTED = f"""
WITH RECURSIVE {SUBWORDS},
sw AS (SELECT doc_id, sent_pos, sentence, {WORDS.format('sentence')} AS words FROM ({SENTS})),
sc AS (SELECT doc_id, sent_pos, sum(cost)::BIGINT AS c FROM (SELECT doc_id, sent_pos, unnest(words) AS word FROM sw) JOIN costs USING (word) GROUP BY doc_id, sent_pos),
s AS MATERIALIZED (SELECT doc_id, sent_pos AS i, sentence, len(words) AS w, coalesce(c, 0) AS c FROM sw LEFT JOIN sc USING (doc_id, sent_pos)),
p AS (
  SELECT doc_id, i, 0::BIGINT AS chunk_pos, w AS n FROM s WHERE i = 0
  UNION ALL
  SELECT s.doc_id, s.i, CASE WHEN p.n + s.c <= 64 THEN p.chunk_pos ELSE p.chunk_pos + 1 END, CASE WHEN p.n + s.c <= 64 THEN p.n + s.w ELSE s.w END
  FROM p JOIN s ON s.doc_id = p.doc_id AND s.i = p.i + 1)
SELECT p.doc_id, p.chunk_pos, trim(string_agg(s.sentence, ' ' ORDER BY s.i), E' \\n\\t') AS chunk
FROM p JOIN s ON s.doc_id = p.doc_id AND s.i = p.i GROUP BY p.doc_id, p.chunk_pos"""

CONTEXT_TAGS = f"""
WITH RECURSIVE tok AS MATERIALIZED (
  SELECT doc_id, sent_pos, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos
  FROM (SELECT doc_id, sent_pos, {WORDS.format('sentence')} AS ws FROM ({SENTS}))),
lab AS MATERIALIZED (SELECT *, lag(tag) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM (SELECT doc_id, pos, word,
  CASE WHEN length(word) % 5 = 0 THEN 'ADV' WHEN length(word) % 5 = 1 THEN 'NUM' WHEN pos % 2 = 1 THEN 'VERB' ELSE 'NOUN' END AS tag
  FROM tok WHERE sent_pos = 0)),
tags AS (SELECT tag, count(*) AS n FROM lab GROUP BY tag),
t AS (SELECT count(*) AS k FROM tags), voc AS (SELECT count(DISTINCT word) AS v FROM lab),
moves AS (SELECT before AS a, tag AS b, count(*) AS n FROM lab GROUP BY before, tag),
outs AS (SELECT a, sum(n) AS n FROM moves GROUP BY a),
tr AS MATERIALIZED (SELECT x.a, y.tag AS b, ln((coalesce(m.n, 0) + 1)::DOUBLE / (coalesce(o.n, 0) + k)) AS p
  FROM (SELECT tag AS a FROM tags UNION ALL SELECT NULL) x CROSS JOIN tags y CROSS JOIN t
  LEFT JOIN moves m ON m.a IS NOT DISTINCT FROM x.a AND m.b = y.tag LEFT JOIN outs o ON o.a IS NOT DISTINCT FROM x.a),
pw AS MATERIALIZED (SELECT word, tag, count(*) AS n FROM lab GROUP BY word, tag),
em AS MATERIALIZED (SELECT doc_id, sent_pos, pos, tags.tag, ln((coalesce(pw.n, 0) + 1)::DOUBLE / (tags.n + v + 1)) AS e
  FROM tok CROSS JOIN tags CROSS JOIN voc LEFT JOIN pw ON pw.word = tok.word AND pw.tag = tags.tag),
v AS MATERIALIZED (
  SELECT doc_id, sent_pos, pos, tag, p + e AS score, NULL::VARCHAR AS prev FROM em JOIN tr ON tr.a IS NULL AND tr.b = tag WHERE pos = 0
  UNION ALL
  SELECT q.doc_id, q.sent_pos, q.pos, q.tag, m + e, q.prev FROM (
    SELECT doc_id, sent_pos, v.pos + 1 AS pos, tr.b AS tag, max(round(score + p, 9)) AS m,
      arg_min(v.tag, struct_pack(s := -round(score + p, 9), t := v.tag)) AS prev
    FROM v JOIN tr ON tr.a = v.tag GROUP BY doc_id, sent_pos, v.pos, tr.b) q
  JOIN em ON em.doc_id = q.doc_id AND em.sent_pos = q.sent_pos AND em.pos = q.pos AND em.tag = q.tag),
ends AS (SELECT doc_id, sent_pos, max(pos) AS pos FROM tok GROUP BY doc_id, sent_pos),
bt AS (
  SELECT doc_id, sent_pos, pos, arg_min(tag, struct_pack(s := -round(score, 9), t := tag)) AS tag FROM v JOIN ends USING (doc_id, sent_pos, pos)
  GROUP BY doc_id, sent_pos, pos
  UNION ALL
  SELECT v.doc_id, v.sent_pos, v.pos - 1, v.prev FROM bt JOIN v ON v.doc_id = bt.doc_id AND v.sent_pos = bt.sent_pos AND v.pos = bt.pos AND v.tag = bt.tag
  WHERE v.prev IS NOT NULL)
SELECT doc_id, sent_pos, string_agg(tag, ' ' ORDER BY pos) AS tags FROM bt GROUP BY doc_id, sent_pos"""

_FRAMES = (
    "SELECT doc_id, sent_pos, sentence, array_to_string(list_transform(list_filter("
    + WORDS.format("sentence") + ", lambda w: length(w) >= 8), lambda w: w[:4] || '_' || w[5:]), ' ') AS frames"
    f" FROM ({SENTS}) WHERE length(sentence) > 0"
)
_CHUNKS = (
    "SELECT doc_id, lang, i AS chunk_pos, array_to_string(w[i * {n} + 1 : i * {n} + {n}], ' ') AS chunk FROM ("
    "SELECT doc_id, lang, w, unnest(range(0, CAST(ceil(len(w) / {n}) AS BIGINT))) AS i FROM ("
    "SELECT doc_id, lang, " + WORDS.format("text") + " AS w FROM documents))"
)
_PROMPTS = (
    "SELECT doc_id, chunk_pos, '<startoftext>Sentence: ' || chunk || chr(10) || 'Research Design: ' || lang || '<endoftext>' AS prompt"
    f" FROM ({_CHUNKS.format(n=32)})"
)
_GRAM = {
    1: "w",
    2: "list_transform(range(1, len(w)), lambda i: array_to_string(w[i : i + 1], ' '))",
    3: "list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))",
}

QUERIES = {
    "bracket_cleanup": bracket_cleanup,
    "noise_filter": noise_filter,
    "alpha_stop_filter": alpha_stop_filter,
    "lexicon_lemma": lexicon_lemma,
    "word_tokens": word_tokens,
    "whitespace_words": whitespace_words,
    "sentences": sentences,
    "word_chunks": word_chunks,
    "ngrams": ngrams,
    "sentence_pack": sentence_pack,
    "context_tags": context_tags,
    "subword_costs": subword_costs,
    "subword_pack": subword_pack,
    "sentence_frames": sentence_frames,
    "frame_pack": frame_pack,
    "prompt_render": prompt_render,
    "answer_extract": answer_extract,
}

ORACLE = {
    "bracket_cleanup": "SELECT doc_id, regexp_replace(lower(text), '([(\\[])[^\\n]*?([)\\]])', '\\1\\2', 'g') AS clean FROM documents",
    "noise_filter": "SELECT doc_id, array_to_string(list_filter(" + WORDS.format("lower(text)")
    + ", lambda w: length(w) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in st.NOISE_WORDS)
    + "], w)), ' ') AS clean FROM documents",
    "alpha_stop_filter": f"""
WITH stop AS MATERIALIZED ({STOP}), bag AS (SELECT list(word) AS stop FROM stop),
kept AS (SELECT doc_id, list_filter({WORDS.format('lower(text)')},
         lambda w: NOT list_contains(bag.stop, w) AND regexp_full_match(w, '\\p{{L}}+')) AS k FROM documents, bag)
SELECT doc_id, len(k)::BIGINT AS n_kept, array_to_string(k, ' ') AS clean FROM kept""",
    "lexicon_lemma": f"""
SELECT doc_id, array_to_string(list_transform(list_filter({WORDS.format('lower(text)')},
  lambda w: length(w) % 5 > 1), lambda w: regexp_replace(w, 's$', '')), ' ') AS text FROM documents""",
    "word_tokens": """
SELECT doc_id, len(t)::BIGINT AS n_terms, md5(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS t FROM documents)""",
    "whitespace_words": f"""
SELECT doc_id, len(t)::BIGINT AS n_words, md5(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, {WORDS.format('text')} AS t FROM documents)""",
    "sentences": f"SELECT doc_id, sent_pos, sentence FROM ({SENTS})",
    "word_chunks": f"SELECT doc_id, lang AS label, chunk_pos, chunk FROM ({_CHUNKS.format(n=500)})",
    "ngrams": " UNION ALL ".join(
        f"SELECT doc_id, {n}::BIGINT AS n, len(g)::BIGINT AS n_grams, md5(array_to_string(g, '|')) AS digest FROM "
        f"(SELECT doc_id, {g} AS g FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents))"
        for n, g in _GRAM.items()
    ),
    "sentence_pack": "SELECT p.doc_id, lang AS label, chunk_pos, chunk FROM ("
    + _packed_sql(f"SELECT doc_id, sent_pos, sentence, '' AS frames FROM ({SENTS})", 32)
    + ") p JOIN documents USING (doc_id)",
    "context_tags": CONTEXT_TAGS,
    "subword_costs": f"WITH RECURSIVE {SUBWORDS} SELECT word, cost::BIGINT AS cost FROM costs",
    "subword_pack": _COSTED,
    "sentence_frames": f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sent_pos) - 1 AS sent_pos, frames FROM ({_FRAMES})",
    "frame_pack": "SELECT doc_id, chunk_pos, chunk, frame_text FROM ("
    + _packed_sql(
        "SELECT doc_id, sent_pos, sentence, replace(frames, '_', ' ') AS frames FROM (" + _FRAMES + ") WHERE frames <> ''", 512
    )
    + ")",
    "prompt_render": _PROMPTS,
    "answer_extract": f"""
SELECT doc_id, chunk_pos, split_part(regexp_extract_all(prompt, 'Research Design: ([^\\n]*)', 1)[-1], '<endoftext>', 1) AS answer
FROM ({_PROMPTS})
UNION ALL SELECT doc_id, -1, coalesce(split_part(regexp_extract_all(text, 'Research Design: ([^\\n]*)', 1)[-1], '<endoftext>', 1), 'None') FROM documents""",
}
