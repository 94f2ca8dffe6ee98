import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from fieldloom.llm import token_alignment as ta

TEXTS = [
    "Hello world, these are tokens.  Two  spaces and more   ",
    "  leading", " ", "   ", "\n\nlines\n \n x\t y", "", None, "naïve café – ümlaut ß 日本語のテキスト 🙂🙂  wide space", "<|endoftext|> and <s>x</s> <|endoftext|>", "has ▁ blank sign",
    "don't can't 12345 v1.2.3 (a) \"q\"", "x" * 700, "word " * 900 + "end", "ab" * 3 + " \x00\x01 \x7f", "word " * 900 + "end", "देवनागरी और हिन्दी", "а́ combining é ́alone",
]


def brute(texts):
    a = Tokenizer.from_file(ta.TOKENIZER_A)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=ta.MODEL_B)
    bytes_a = ta._byte_level(a)
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    rows, count = [], Counter()
    for text in texts:
        full = (" " + (text or "")).encode()
        x, y = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        if not text or b"".join(bytes_a[i] for i in x) != full or b"".join(bytes_b[i] for i in y) != full:
            rows.append((0, 0, 0, [], ""))
            continue
        spans = []
        for ids, size in ((x, bytes_a), (y, bytes_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(size[i]), i))
                at += len(size[i])
            spans.append(out)
        links = [(p[2], q[2]) for p in spans[0] for q in spans[1] if p[0] < q[1] and q[0] < p[1]]
        cuts = sorted({p[1] for p in spans[0]} & {q[1] for q in spans[1]})
        groups, before = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(p[2]) for p in s if before <= p[0] < cut) for s in spans))
            before = cut
        rows.append((len(x), len(y), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        count.update(links)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return [(p, q, g, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), d) for p, q, g, links, d in rows]


@pytest.mark.parametrize("parts, chunk", [(1, 4 << 20), (5, 64)])
def test_rows_against_brute_force(spark, monkeypatch, parts, chunk):
    monkeypatch.setattr(ta, "CHUNK_BYTES", chunk)
    rows = [(i // 2, t, "x", 1, "y") for i, t in enumerate(TEXTS)] + [(None, "Hello world", "x", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, chunk int, pairs string").repartition(parts)
    found = sorted((tuple(r) for r in ta.aligned(docs).collect()), key=repr)
    assert found == sorted(((r[0], *x) for r, x in zip(rows, brute([r[1] for r in rows]), strict=True)), key=repr)


def test_empty_table(spark):
    assert ta.aligned(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in ta.aligned(spark.createDataFrame([(1, None), (1, "")], "doc_id long, text string")).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_chunked_ids_are_those_of_whole_texts():
    rng = np.random.default_rng(3)
    signs = list("ab  ..'\n\té日<|>_-1")
    texts = ["".join(rng.choice(signs, int(rng.integers(1, 60)))) for _ in range(400)]
    a = Tokenizer.from_file(ta.TOKENIZER_A)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=ta.MODEL_B)
    full, found = ta.align(pa.array(texts))
    assert full.all()
    for i, text in enumerate(texts):
        assert found.a[found.first_a[i] : found.first_a[i + 1]].tolist() == a.encode(" " + text, add_special_tokens=False).ids
        assert found.b[found.first_b[i] : found.first_b[i + 1]].tolist() == b.encode(text)
