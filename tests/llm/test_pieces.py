import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from corpuslab.llm import pieces, queries

FILE = public_tokenizers.path("piece_bpe_32k.model")


def real():
    with open(FILE, "rb") as file:
        return file.read()


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def field(number, value):
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def compiled_map(rules):
    """A double-array trie of the rules, built node by node, and the replacements."""
    texts, values = b"", {}
    for key, made in rules.items():
        values[key.encode()] = len(texts)
        texts += made.encode() + b"\0"
    children = {}
    for key in values:
        for i in range(len(key)):
            children.setdefault(key[:i], set()).add(key[i])
    units, used = [0] * 4096, {0}

    def place(prefix, node, label):
        labels = sorted(children.get(prefix, ()))
        ends = prefix in values
        base = next(b for b in range(1, 3800) if all((node ^ b ^ x) not in used for x in ([0] if ends else []) + labels))
        units[node] = base << 10 | (ends << 8) | label
        at = node ^ base
        if ends:
            used.add(at)
            units[at] = values[prefix] | 1 << 31
        used.update(at ^ x for x in labels)
        for x in labels:
            place(prefix + bytes([x]), at ^ x, x)

    place(b"", 0, 0)
    raw = b"".join(struct.pack("<I", u) for u in units)
    return struct.pack("<I", len(raw)) + raw + texts


RULES = {
    "ﬁ": "fi", "½": "1/2", "Ａ": "A", "á": "á", "áb": "áβ", "​": "", "　": " ", "\t": " ", "\n": " ",
    "xy": "  z  ", "ab": "", "…": "...",
}


def small_model(rules, fallback=True, dummy=1, squeeze=1):
    made = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if fallback:
        made += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    merges = ["▁a", "fi", "in", "▁t", "he", "▁the", "fin", "aa", "▁▁", "aaa", "...", "..", "er", "▁fi", "zz", "1/2", "/2"]
    made += [(m, -float(i // 2), 1) for i, m in enumerate(merges)]  # pairs of merges tie
    made += [(c, -100.0 - i, 1) for i, c in enumerate("▁abcdefghinrtuz1/2.áβ日")]
    body = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in made)
    trainer = field(3, 2) + field(4, len(made)) + field(35, int(fallback)) + field(40, 0)
    normalizer = field(1, b"own") + field(2, compiled_map(rules) if rules else b"") + field(3, dummy) + field(4, squeeze) + field(5, 1)
    return body + field(2, trainer) + field(3, normalizer)


def spans(library, text):
    """(id, begin, end) in bytes, from the library's own message."""
    out = []
    for number, value in pieces._fields(library.encode(text, out_type="serialized_proto")):
        if number == 2:
            own = dict(pieces._fields(value))
            out.append((own.get(2, 0), own.get(4, 0), own.get(5, 0)))
    return out


TEXTS = [
    "", " ", "   ", "a", " a ", "a  b   c", "the finer  aaaa", "▁x", "▁▁▁▁▁ y", "line\nline\r\n\ttab\x00nul", "日本語 😀😀 ﬁ½Ａ",
    "áb á xyxy", "​start ​", "​", "\t\n", "ab", "ab ab", "…… ...", "<s> </s> <unk> <0x41>", "e" * 200, "é" * 90 + " z",
    " " * 70 + "x" + " " * 30, "aaaaaaa" * 30, "� ok", "finfinfin the/the", "　　wide　",
]


def random_texts(n, seed):
    rng = random.Random(seed)
    alphabet = "aaabcdefghinrtuz12./  ▁\n\t日é😀ﬁ​́xy…½"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("model", [
    real(), small_model(RULES), small_model({}), small_model(RULES, squeeze=0), small_model(RULES, fallback=False),
    small_model(RULES, dummy=0), small_model({}, dummy=0, squeeze=0)], ids=["real", "map", "none", "keep", "unknown", "bare", "raw"])
def test_like_the_library(model, monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    codec = pieces.Codec(model)
    for keep in (pieces.KEEP, 1):
        monkeypatch.setattr(pieces, "KEEP", keep)
        codec.known.clear()
        for text in TEXTS + random_texts(1500, 1):
            ids, begin, end = (x.tolist() for x in codec.encode([text.encode()])[0])
            assert ids == library.encode(text), text
            assert list(zip(ids, begin, end)) == spans(library, text), text
            assert codec.decode(ids).decode() == library.decode(ids), text


@pytest.mark.parametrize("model", [real(), small_model(RULES), small_model(RULES, fallback=False), small_model({}, dummy=0, squeeze=0)])
def test_decodes_any_ids(model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    codec, rng = pieces.Codec(model), random.Random(3)
    size = library.get_piece_size()
    for _ in range(3000):
        ids = [rng.randrange(min(size, 262 if rng.random() < 0.5 else size)) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids).decode() == library.decode(ids), ids
    with pytest.raises(ValueError):
        codec.decode([size])


def test_many_texts_at_once_with_a_small_memory(monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    codec, texts = pieces.Codec(real()), random_texts(2000, 9) + TEXTS
    monkeypatch.setattr(pieces, "CACHE", 500)
    monkeypatch.setattr(pieces, "AT_ONCE", 7)
    for at in range(0, len(texts), 100):
        part = texts[at: at + 100]
        assert [ids.tolist() for ids, *_ in codec.encode([t.encode() for t in part])] == library.encode(part)
        assert len(codec.known) <= 500 + 100 * 60


def test_spans_cover_the_text():
    codec = pieces.Codec(real())
    for text in random_texts(300, 5):
        raw = text.encode()
        _, begin, end = codec.encode([raw])[0]
        assert b"".join(raw[b:e] for b, e in zip(begin, end)) == raw


def test_character_map_takes_the_longest_key():
    table = pieces.CharacterMap(compiled_map(RULES))
    assert table.longest("ábc".encode(), 0) == ("áβ".encode(), 4)
    assert table.longest("ác".encode(), 0) == ("á".encode(), 3)
    assert table.longest(b"ac", 0) is None and table.longest("​".encode(), 0) == (b"", 3)


def test_refuses_other_models():
    with pytest.raises(ValueError):
        pieces.Model(field(1, field(1, b"x") + field(3, 4)) + field(2, field(3, 2)))
    with pytest.raises(ValueError):
        pieces.Model(field(1, field(1, b"x")) + field(2, field(3, 1)))


def test_malformed_bytes_are_replaced():
    codec = pieces.Codec(real())
    ids, begin, end = codec.encode([b"a\xffb\xe2\x82"])[0]
    assert codec.decode(ids.tolist()).decode() == "a�b��"
    assert end[-1] == 5


def test_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (None, None), (4, "twice"), (4, "twice"), (9, "word ab. " * 200_000)]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, ids int, key int, begin int")
    found = pieces.decode(pieces.encode(df, real()), real())
    assert found.columns == ["doc_id", "ids", "begin", "end", "decoded"]
    want = sorted((repr(i), library.encode(t or "")) for i, t in rows)
    rows_found = found.collect()
    assert sorted((repr(r.doc_id), r.ids) for r in rows_found) == want
    at_once = pieces.encode(df, real(), decoded=True).collect()
    assert sorted(map(repr, at_once)) == sorted(map(repr, rows_found))
    empty = pieces.digests(pieces.decode(pieces.encode(df.limit(0), real()), real()))
    assert empty.collect() == []


def test_query(spark):
    directory = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    want = []
    for r in spark.read.parquet(f"{directory}/documents.parquet").collect():
        ids = library.encode(r.text or "")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        want.append((r.doc_id, len(ids), *sha))
    assert sorted(map(tuple, queries.op12_sentencepiece(spark, directory).collect())) == sorted(want)
