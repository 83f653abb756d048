"""The queries' results against brute force on small fixtures, with nulls, ties, repeats and empty tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm.embedding_dedup import embedding_components
from tessera.llm.exact_dedup import drop_exact_copies, exact_dedup
from tessera.llm.language_id import predict_language, with_known_language
from tessera.llm.mixing import mix, mixed_documents
from tessera.llm.packing import pack, piece_digests
from tessera.llm.queries import tokenizer_file
from tessera.llm.simhash_dedup import drop_near_copies, simhash_components
from tessera.llm.token_store import token_output

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, bucket int"


def corpus(spark, n=150, seed=1):
    draw = random.Random(seed)
    words = {x: ["".join(draw.choice(x) for _ in range(draw.randint(2, 7))) for _ in range(60)] for x in ("abcdeé", "mnopqß")}
    rows = []
    for i in range(n):
        alphabet = draw.choice(sorted(words))
        text = " ".join(draw.choice(words[alphabet]) for _ in range(draw.choice([0, 1, 3, 30, 200])))
        if i % 5 == 0 and rows:
            text = rows[draw.randrange(len(rows))][1] or ""
            text = text.replace(" ", "\t \n", 1) if i % 2 else text + " x"
        rows.append((i * 3 % 401, text, "ab" if set(text) & set("abcde") else "mn", f"s{min(i % 7, 3)}", len(text), "d", 1))
    rows += [(900, None, None, None, None, "d", 2), (901, "", "ab", "s0", 0, "d", 2), (902, " \t ", None, "s9", 3, "d", 2), (903, "word " * 20_000, "ab", "s0", 100_000, "d", 2)]
    draw.shuffle(rows)
    return rows, spark.createDataFrame(rows, DOCS).repartition(6)


def test_exact_dedup(spark):
    rows, df = corpus(spark)
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    want = sorted((i, min(g), len(g), i == min(g)) for g in groups.values() for i in g)
    assert sorted((r[0], r[1], r[2], r[3]) for r in exact_dedup(df).collect()) == want
    assert drop_exact_copies(df).count() == len(groups)
    assert exact_dedup(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None)], "doc_id long, text string")
    assert sorted(r[3] for r in exact_dedup(twice).collect()) == [False, False, True, True]
    assert drop_exact_copies(twice).count() == 2


def print_of(text, width=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    head = {i: i for i in ids}

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in linked:
        x, y = root(a), root(b)
        head[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash(spark):
    rows, df = corpus(spark, 200, 4)
    prints = {r[0]: print_of(r[1]) for r in rows}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    heads = components(prints, links)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(df).collect()}
    assert got == {i: (f"{p:016x}", heads[i]) for i, p in prints.items()}
    assert sorted(r.doc_id for r in drop_near_copies(df).collect()) == sorted(set(heads.values()))
    assert simhash_components(df.limit(0)).count() == 0


def test_embeddings(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(12, 16))
    vectors = [(i, (base[i % 12] + draw.normal(size=16) * (0.02 if i % 3 else 0.35)).astype("f4"), i % 2 if i % 17 else None) for i in range(240)]
    rows = [(i, [float(x) for x in v], label) for i, v, label in vectors]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, rows[1][1], rows[1][2]), (504, [], 0), (505, [None] * 16, 0)]
    good = {i: (np.array(v, "f4").astype(float), label) for i, v, label in rows if v and None not in v and np.isfinite(v).all() and any(v) and label is not None}
    unit = {i: v / np.linalg.norm(v) for i, (v, _) in good.items()}
    links = [(a, b) for a in unit for b in unit if a < b and good[a][1] == good[b][1] and unit[a] @ unit[b] >= 0.93]
    heads, n = components([r[0] for r in rows], links), Counter(x for ab in links for x in ab)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_components(df, tile=40).collect()}
    assert got == {i: (n[i], heads[i], heads[i] == i) for i, _, _ in rows}
    assert embedding_components(df.limit(0)).count() == 0


def test_mixing(spark):
    rows, df = corpus(spark)
    got = mix(df).collect()
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    source = {r[0]: r[3] for r in rows}
    whole = Counter()
    for i, n in size.items():
        whole[source[i]] += n
    order = sorted((s for s in whole if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped: dict = {}
    while True:  # reshare what targets above the cap leave over
        rest = sum(whole.values()) - sum(capped.values())
        free = sum(w for s, w in weight.items() if s not in capped)
        over = {s: 3 * whole[s] for s in order if s not in capped and rest * weight[s] / free > 3 * whole[s]}
        if not over:
            break
        capped |= over
    target = {s: capped.get(s, rest * weight[s] / free if free else 0) for s in order}
    taken = Counter()
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], whole[source[r.doc_id]]) and 0 <= r.taken <= 3 * r.size
        assert r.target == pytest.approx(target[source[r.doc_id]], abs=1e-3)
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order) and len(got) == len(rows)
    assert sorted(mix(df.repartition(3)).collect()) == sorted(got)
    assert mix(df.limit(0)).count() == 0
    assert set(mixed_documents(df).columns) == set(df.columns)


def ids_of(name, text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(name))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing(spark):
    rows, df = corpus(spark)
    rows = [*rows, (905, "Ünïcode — naïve ‘quotes’ 12345 日本語 é", None, "s", 1, "d", 1)]
    df = df.union(spark.createDataFrame(rows[-1:], DOCS))
    want = {r[0]: ids_of("word_bpe_49k.json", r[1], 1) for r in rows}
    pieces = piece_digests(pack(df, tokenizer_file("word_bpe_49k.json"))).collect()
    seen, filled = defaultdict(int), defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids = want[p.doc_id]
        assert (p.start, p.doc_tokens) == (seen[p.doc_id], len(ids)) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        seen[p.doc_id] += p.length
        filled[p.sequence_id].append((p.offset, p.length))
    assert seen == {i: len(x) for i, x in want.items()}
    used = padded = 0
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= 2048
        used, padded = used + at, padded + (at if at & (at - 1) == 0 else 2048)
    assert padded <= 1.05 * used


def test_token_store(spark):
    rows, df = corpus(spark)
    at = 0
    for r, got in zip(sorted(rows), token_output(df, tokenizer_file("byte_bpe_50k.json")).orderBy("doc_id").collect(), strict=True):
        ids = ids_of("byte_bpe_50k.json", r[1], 0)
        assert tuple(got) == (r[0], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_output(df.limit(0), tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_language_id(spark):
    rows, df = corpus(spark, 400, 8)
    got = {r.doc_id: r for r in predict_language(df, fit_docs=120).collect()}
    assert len(got) == len({r[0] for r in rows})
    known = [r for r in rows if len(r[1] or "") > 40 and r[0] < 900]
    assert sum(got[r[0]].lang_pred == r[2] for r in known) >= 0.95 * len(known)
    for r in rows:
        x = got[r[0]]
        assert x.held_out == (zlib.crc32(str(r[0]).encode()) % 4 == 2) and 0 <= x.score <= 1
        assert (x.lang_pred == "und") == (not any(c.isalpha() for c in r[1] or ""))
    assert predict_language(df.limit(0)).count() == 0
