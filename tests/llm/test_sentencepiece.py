import hashlib
import itertools
import random

from fieldloom.llm import sentencepiece_nbest as S

TEXTS = ["The reader opens maps.", "", None, " ", "  two  blanks ", "中文 ▁ and ▁▁x", "a\tb\nc\r\n", "émigré naïve", "x" * 3000, "w " * 9000, "\U0001f600!", "end ", "\x00\x01"]


def test_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, TEXTS[0]])], "doc_id long, text string, ids string")
    encoded = S.encode(docs)
    got = {r.doc_id: r.text for r in S.decode(encoded).collect()}
    assert got == {i: t or "" for i, t in enumerate([*TEXTS, TEXTS[0]])}
    rows = {r.doc_id: r for r in encoded.collect()}
    assert rows[0].ids == rows[len(TEXTS)].ids and rows[1].ids == [] and rows[2].ids == []


def paths(pieces, text):
    """All segmentations of a short text, as (score, ids), by plain recursion."""
    shown = text.replace(S.BLANK, "\0").replace(" ", S.BLANK)
    out = []

    def go(i, score, ids):
        if i == len(text):
            out.append((score, ids))
            return
        for j in range(i + 1, len(text) + 1):
            if shown[i:j] in pieces.score:
                s, own = pieces.score[shown[i:j]]
                go(j, score + s, ids + own)
        if shown[i] not in pieces.score:
            own = tuple(pieces.byte[b] for b in text[i].encode())
            go(i + 1, score + pieces.fallback * len(own), ids + own)

    go(0, 0.0, ())
    return sorted(out, key=lambda x: (-x[0], x[1]))


def applied(ids, edits):
    for e in sorted(edits, key=lambda e: -e[0]):
        ids = ids[: e[0]] + e[2] + ids[e[0] + e[1] :]
    return ids


def test_n_best_against_all_paths():
    pieces, rnd = S.Pieces(S.MODEL), random.Random(7)
    for _ in range(40):
        text = "".join(rnd.choice("the in▁é o") for _ in range(rnd.randint(1, 11)))
        encoder = S.Encoder(pieces, 6)
        ids, score, others = encoder.encode(text)
        want = paths(pieces, " " + text)
        # in order of score, equal ones by their ids
        assert [(round(s, 6), tuple(own)) for s, own in [(score, ids), *((s, applied(ids, e)) for s, e in others)]] == [(round(s, 6), p) for s, p in want[:6]]


def test_pieces_agree_with_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=S.MODEL)
    encoder = S.Encoder(S.Pieces(S.MODEL), 1)
    for text in ("Some words here", "naïve 中文"):
        assert model.decode(encoder.encode(text)[0]) == text


def test_small_cache_gives_the_same(monkeypatch):
    texts = [" ".join(w) for w in itertools.permutations(["one", "two", "three", "four"])]
    full = [S.Encoder(S.Pieces(S.MODEL), 3).encode(t) for t in texts]
    monkeypatch.setattr(S, "HELD", 2)
    small = S.Encoder(S.Pieces(S.MODEL), 3)
    assert [small.encode(t) for t in texts] == full


def test_empty(spark):
    assert S.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def k_best(pieces, text, n):
    """Scores and ids of the n best segmentations, equal ones by their ids: ends of every position, from the last to the first."""
    shown = text.replace(S.BLANK, "\0").replace(" ", S.BLANK)
    ends = [[] for _ in text] + [[(0, None, None, 0)]]
    for i in range(len(text) - 1, -1, -1):
        edges = [(*pieces.score[shown[i:j]], j) for j in range(i + 1, min(i + 64, len(text)) + 1) if shown[i:j] in pieces.score]
        if shown[i] not in pieces.score:
            own = tuple(pieces.byte[b] for b in text[i].encode())
            edges.append((pieces.fallback * len(own), own, i + 1))
        ends[i] = sorted((-s + e[0], own, r, j) for s, own, j in edges for r, e in enumerate(ends[j]))[:n]
    out = []
    for first in ends[0]:
        ids, at = [], first
        while at[1]:
            ids += at[1]
            at = ends[at[3]][at[2]]
        out.append((-first[0], ids))
    return out


def test_equal_scores_are_ordered_by_ids():
    pieces = S.Pieces(S.MODEL)
    for text in ("xxxxxxxxxxxxxxx", "-" * 41, "aaaaaaaaaaa", "thethethexxxx"):
        assert [(s, list(ids)) for s, ids in S.best_paths(*pieces.lattice(text), 6)] == k_best(pieces, text, 6)


def test_long_texts_without_blanks():
    """A run of 100,000 characters, and 1 MB of base64: memory and time grow with the length only."""
    import base64

    pieces = S.Pieces(S.MODEL)
    mixed = base64.b64encode(random.Random(3).randbytes(750_000)).decode()
    for text in ("x" * 100_000, "=" * 100_000, "\u4e2d\u6587" * 5_000, mixed):
        ids, score, others = S.Encoder(pieces, 4).encode(text)
        assert b"".join(pieces.raw[i] for i in ids).decode() == " " + text
        if len(text) <= 100_000:
            assert [score, *(s for s, _ in others)] == [s for s, _ in k_best(pieces, " " + text, 4)]


def test_one_text_in_runs_is_the_same(monkeypatch):
    text = "some words,  and 中文 " * 400
    want = S.Encoder(S.Pieces(S.MODEL), 4).encode(text)
    monkeypatch.setattr(S, "PIECE_BYTES", 256)
    assert S.Encoder(S.Pieces(S.MODEL), 4).encode(text) == want


def test_query_gives_a_row_for_each_row(spark, tmp_path):
    rows = [(7, "one text"), (7, "one text"), (7, "another one"), (None, "no id"), (None, None), (8, ""), *[(i, f"text {i}") for i in range(12)]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(((r.doc_id, r.text_sha256, r.n_chars) for r in S.query(spark, str(tmp_path)).collect()), key=repr)
    assert found == sorted(((i, hashlib.sha256((t or "").encode()).hexdigest(), len(t or "")) for i, t in rows), key=repr)
