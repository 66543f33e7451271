"""Phrase mining, vector codes and cost-balanced packing against plain forms."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotext.llm import balanced_packing as bp
from chronotext.llm import phrases as ph
from chronotext.llm import vector_codes as vc

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def plain_phrases(rows, least, longest, top):
    """By counting every phrase of every length."""
    out = []
    by = defaultdict(list)
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        by["und" if lang is None else lang] += [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]
    for lang, pieces in by.items():
        f = Counter(tuple(p[i : i + k]) for p in pieces for k in range(1, longest + 1) for i in range(len(p) - k + 1))
        n = sum(map(len, pieces))
        frequent = [g for g in f if len(g) > 1 and f[g] >= least]
        inside = defaultdict(int)
        for g in frequent:
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    inside[g[i : i + m]] = max(inside[g[i : i + m]], f[g])
        found = []
        for g in frequent:
            if inside[g] < f[g]:
                s, k = min((1000 * f[g] * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                found.append((-s, -f[g], " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts(seed=2):
    r = random.Random(seed)
    vocab = ["A", "bc", "Ärm", "東京", "x\x0bz", "the", "of", "q r", "e"] + [f"w{i}" for i in range(25)]
    rows = [(None, None), ("en", ""), (None, " \t\r\n"), ("en", "...!?"), ("und", "the of A"), ("de", None)]
    for _ in range(120):
        words = [r.choice(vocab) for _ in range(r.randint(0, 60))]
        if r.random() < 0.5:
            words[r.randint(0, len(words)) :] = ["the", "of", "A", "bc", "e", "w1"][: r.randint(2, 6)] * r.randint(1, 3)
        rows.append((r.choice([None, "en", "de", "und"]), "".join(w + r.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n"]) for w in words)))
    rows.append(("en", "the of A bc " * 3000))
    return rows + rows[40:60]


def phrase_frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").repartition(5).select("*", F.lit(1).alias("n"), F.lit("x").alias("key"), F.lit(2).alias("block"), F.lit(3).alias("word"), F.lit(4).alias("id"))


@pytest.mark.parametrize("size,cut", [(4_000_000, 1 << 20), (300, 1 << 20), (40, 30)])
def test_phrases(spark, monkeypatch, size, cut):
    monkeypatch.setattr(ph, "BLOCK_WORDS", size)
    monkeypatch.setattr(ph, "SLICE", cut)
    rows = texts()
    got = sorted(map(tuple, ph.mine_phrases(phrase_frame(spark, rows), least=6, top=40).collect()))
    assert got == plain_phrases(rows, 6, 5, 40)
    assert {x[0] for x in got} == {"en", "de", "und"} and max(len(x[2].split()) for x in got) == 5


def test_phrases_of_slices_and_none(spark, monkeypatch):
    monkeypatch.setattr(ph, "SLICE", 50)
    rows = texts(5)[:80]
    assert sorted(map(tuple, ph.mine_phrases(phrase_frame(spark, rows), least=3, longest=3, top=None).collect())) == plain_phrases(rows, 3, 3, None)
    assert ph.mine_phrases(phrase_frame(spark, rows).limit(0)).count() == 0
    assert ph.mine_phrases(phrase_frame(spark, rows), least=10**6).count() == 0


def test_radix_order():
    r = np.random.default_rng(3)
    keys = r.integers(0, 70_000, (5000, 3)).astype(np.uint32) % np.array([3, 70_000, 2], np.uint32)
    assert (ph.radix_order(keys) == np.lexsort(keys.T[::-1])).all()


def plain_codes(rows, parts, entries, scale, rounds):
    kept = sorted(((v, x, lab) for v, x, lab in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)), key=lambda r: r[:2])
    grid = [[int(np.floor(scale * c)) for c in x] for _, x, _ in kept]
    p = len(grid[0]) // parts
    cut = [[g[j * p : (j + 1) * p] for g in grid] for j in range(parts)]
    books = [c[:entries] for c in cut]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((far(x, e), i) for i, e in enumerate(books[j])) for x in cut[j]] for j in range(parts)]
    for _ in range(rounds):
        a = assign()
        for j in range(parts):
            for e in range(len(books[j])):
                own = [x for x, (_, i) in zip(cut[j], a[j], strict=True) if i == e]
                books[j][e] = [sum(c) // len(own) for c in zip(*own, strict=True)] if own else books[j][e]
    a = assign()
    return books, sorted(((v, bytes(a[j][k][1] for j in range(parts)).hex(), sum(a[j][k][0] for j in range(parts)), lab) for k, (v, _, lab) in enumerate(kept)), key=str)


def vectors(seed=4, n=150):
    r = random.Random(seed)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5, r.gauss(0, 0.3)]) for _ in range(12)], r.choice([None, 1, 2])) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [1.0] * 11 + [None], 1), (n + 2, [float("nan")] * 12, 2), (n + 3, [float("inf")] + [0.0] * 11, None), (n + 4, [1.0] * 6, 1), (n + 5, [], 1)]
    return rows + [(7, rows[7][1], 1), (7, rows[7][1], None)]


def vector_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4).select("*", F.lit(1).alias("v"), F.lit(2).alias("codes"), F.lit(3).alias("slot"))


def test_vector_codes(spark):
    rows = vectors()
    model = vc.compress(vector_frame(spark, rows), rounds=4, parts=4, entries=6, scale=64)
    got = vc.digest_columns(model).collect()
    books, want = plain_codes([x for x in rows if x[1] is None or len(x[1]) == 12], 4, 6, 64, 4)
    assert model.books.tolist() == books
    key = lambda x: str(x)
    assert sorted(((r.vec_id, r.code, r.error) for r in got), key=key) == sorted((w[:3] for w in want), key=key)
    totals = Counter()
    for w in want:
        totals[w[3]] += w[2]
    assert Counter((r.vec_id, r.label_error) for r in got) == Counter((w[0], totals[w[3]]) for w in want)
    assert len({r.codebooks_sha256 for r in got}) == 1


def test_vector_codes_of_few_far_and_none(spark):
    few = [(3, [1.0, 2.0], None), (None, [5.0, -1.0], None), (2, [0.1, 0.2], None)]
    got = {r.vec_id: r.code for r in vc.digest_columns(vc.compress(vector_frame(spark, few), rounds=2, parts=2)).collect()}
    assert got == {2: "0000", 3: "0101", None: "0202"}
    assert vc.digest_columns(vc.compress(vector_frame(spark, few).limit(0))).count() == 0
    with pytest.raises(ValueError):
        vc.compress(vector_frame(spark, [(1, [1.0, 2.0, 3.0], 1)]), parts=2)
    v = np.random.default_rng(1).integers(-vc.MOST, vc.MOST, (9, 2, 40)).astype(np.int32)
    books = v[:3].transpose(1, 0, 2).astype(np.int64)
    want = [[[sum((int(a) - int(b)) ** 2 for a, b in zip(x, e, strict=True)) for e in books[j]] for x in v[:, j]] for j in range(2)]
    assert vc.distances(v, books).tolist() == want and vc.quantise(np.array([1e30, -1e30]), 4096).tolist() == [vc.MOST, -vc.MOST]


def test_contributions_are_of_changed_parts():
    v = np.arange(24, dtype=np.int32).reshape(4, 2, 3)
    old, new = np.array([[0, 1], [1, 1], [0, 0], [1, 0]], np.uint8), np.array([[0, 1], [0, 1], [0, 0], [1, 1]], np.uint8)
    d = vc.contributions(v, old, new, 2)
    assert d[0, 0].tolist() == [*v[1, 0].tolist(), 1] and d[0, 1].tolist() == [*(-v[1, 0]).tolist(), -1]
    assert d[1, 1].tolist() == [*v[3, 1].tolist(), 1]
    whole = vc.contributions(v, None, old, 2) + d
    assert (whole == vc.contributions(v, None, new, 2)).all()


def test_balance():
    r = random.Random(6)
    for _ in range(60):
        lengths = [r.choice([1, 5, 64, 65, r.randint(1, 300)]) for _ in range(r.randint(1, 80))]
        rows = bp.balance(lengths, 64)
        assert [sum(p[2] for p in row) for row in rows] == bp.capacities(sum(lengths), 64)
        assert sorted((d, s + i) for row in rows for d, s, n in row for i in range(n)) == [(d, i) for d, n in enumerate(lengths) for i in range(n)]
    lengths = [r.randint(100, 900) for _ in range(300)]
    cost = lambda rows: [sum(bp.LINEAR * n + bp.QUADRATIC * n * n for _, _, n in row) for row in rows if sum(p[2] for p in row) == 2048]
    chained, row, room = [[]], [], 2048
    for d, n in enumerate(lengths):
        while n:
            take = min(n, room)
            chained[-1].append((d, 0, take))
            n, room = n - take, room - take
            if not room:
                chained.append([])
                room = 2048
    assert np.std(cost(bp.balance(lengths, 2048))) < np.std(cost(chained)) / 2


def test_packed_pieces(spark, monkeypatch):
    from tokenizers import Tokenizer
    import public_tokenizers as P

    monkeypatch.setattr(bp, "BLOCK_TOKENS", 3000)
    r = random.Random(8)
    alphabet = " \n\tabcABC123,.!?'\"s中文éü😀́\x00 \x85"
    rows = [(None, "no id"), (1, None), (2, ""), (3, "a<|endoftext|>b <|endoftext|>"), (4, "word " * 4000), (5, "x" * 3000), (5, "same id"), (6, "twice"), (6, "twice")]
    rows += [(i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 400)))) for i in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select("*", F.lit(1).alias("ids"), F.lit(2).alias("sequence_id"))
    packed = bp.pack_balanced(docs, RANKS)
    codec = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter((d, tuple(codec.encode(t or "", add_special_tokens=False).ids + [1])) for d, t in rows)
    seen, parts = Counter(), defaultdict(list)
    sequences = packed.collect()
    for s in sequences:
        ids = np.frombuffer(bytes(s.ids), "<u4")
        assert len(ids) == s.n_tokens and s.n_tokens & (s.n_tokens - 1) == 0
        assert [p.offset for p in s.pieces] == np.cumsum([0] + [p.length for p in s.pieces])[:-1].tolist()
        for p in s.pieces:
            parts[p.doc_id, p.doc_tokens].append((p.start, ids[p.offset : p.offset + p.length].tolist()))
    assert len({s.sequence_id for s in sequences}) == len(sequences)
    for (d, n), own in parts.items():
        at = defaultdict(list)
        for start, ids in own:
            at[start].append(ids)
        while at[0]:  # a document from its pieces; rows of one id and length here are equal
            flat = []
            while len(flat) < n:
                flat += at[len(flat)].pop()
            seen[d, tuple(flat)] += 1
    assert seen == want
    got = bp.pieces_of(packed).collect()
    flat = {s.sequence_id: np.frombuffer(bytes(s.ids), "<u4") for s in sequences}
    assert all(zlib.crc32(flat[g.sequence_id][g.offset : g.offset + g.length].tobytes()) == g.ids_crc32 for g in got) and len(got) == sum(len(s.pieces) for s in sequences)
    assert bp.pieces_of(bp.pack_balanced(docs.limit(0), RANKS)).count() == 0


def test_blocks_send_few_bytes():
    """Keys travel in a few bytes each, with the block's numbers of them implied, and come back as they were."""
    r = np.random.default_rng(5)
    words = np.minimum(r.zipf(1.3, 200_000), 40_000).astype(np.uint32)
    words[r.integers(0, len(words), 9_000)] = 0
    assert (ph.unsqueezed(ph.squeezed(words)) == words).all() and len(ph.unsqueezed(ph.squeezed(words[:0]))) == 0
    rows = [x for batch in ph.counted_block(7, words, words > 0, 2, 16) for x in batch.to_pylist()]
    sent = sorted((x for x in rows if x["keys"]), key=lambda x: x["local"])
    assert sum(len(x["keys"]) for x in sent) + len(rows[0]["words"]) + len(rows[0]["marks"]) < 4 * len(words)
    got = {}
    for x in sent:
        first, second, n = ph.unsqueezed(x["keys"]).reshape(3, -1)
        assert x["local"] == len(got)
        got |= dict(zip(zip(np.cumsum(first, dtype=np.uint32).tolist(), second.tolist(), strict=True), n.tolist(), strict=True))
    pairs = [(a, b) for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True) if a and b]
    assert got == Counter(pairs)
