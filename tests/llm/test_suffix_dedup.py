import hashlib
import random

from tessera.llm.suffix_dedup import repeated_spans


def brute(docs, length):
    """First starts of all strings by a dictionary, documents in (id, null last) order."""
    seen, out = set(), []
    for doc, raw in docs:
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        n_spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(raw), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(found):
    return sorted(((r[0], r[1], r[2], len(r[3]), r[4]) for r in found.collect()), key=str)


def sample(seed, n=120):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 7)))
    passages = [" ".join(word() for _ in range(draw.randint(3, 60))) for _ in range(6)]
    texts = []
    for _ in range(n):
        kind = draw.random()
        if kind < 0.3 and texts:
            words = draw.choice(texts).split(" ")
            for _ in range(draw.randint(0, 4)):
                words[draw.randrange(len(words))] = word()
            texts.append(" ".join(words))
        else:
            body = [" ".join(word() for _ in range(draw.randint(0, 40))) for _ in range(3)]
            texts.append(" ".join([body[0], draw.choice(passages), body[1], draw.choice(passages), body[2]]))
    return [*texts, "", "x" * 700, "ab" * 300, "short"]


def test_equals_brute_force_at_two_lengths(spark):
    for seed, length in ((1, 100), (2, 20), (3, 40)):
        texts = sample(seed)
        docs = [(i * 3, t) for i, t in enumerate(texts)] + [(-5, None)]
        random.Random(seed).shuffle(docs)
        df = spark.createDataFrame([(t, i, "z") for i, t in docs], "text string, doc_id long, u string").repartition(7)
        want = brute(sorted((i, (t or "").encode()) for i, t in docs), length)
        assert rows_of(repeated_spans(df, length=length, group_bytes=3000)) == want


def test_many_segments_round_one_anchor(spark):
    core = "the one passage that very many documents share, word for word, and a little more of it"
    docs = [(i, f"{i * 7919 % 1000:04d} {core} {i * 104729 % 1000:04d} tail {i % 5}") for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute([(i, t.encode()) for i, t in docs], 60)
    assert rows_of(repeated_spans(df, length=60)) == want


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = "all work and no play makes a dull text " * 5
    df = spark.createDataFrame([(1, text), (1, text), (None, text + "tail"), (2, None)], "doc_id long, text string")
    found = {(r[0], r[1], r[2]) for r in repeated_spans(df).collect()}
    whole, period = len(text), len("all work and no play makes a dull text ")
    assert (1, whole, whole) in found and (1, whole, whole - period) in found
    assert (2, 0, 0) in found and any(r[0] is None and r[2] >= whole for r in found)
    assert repeated_spans(df.limit(0)).count() == 0


def test_a_passage_in_a_third_of_the_texts_fills_no_bucket():
    """Decided windows are dealt by document, so buckets stay even; all but one of a task's copies are decided there."""
    import pyarrow as pa

    from tessera.llm.suffix_dedup import _spread

    draw = random.Random(8)
    noise = lambda n: bytes(draw.randrange(97, 123) for _ in range(n))
    passage = noise(400)
    texts = [noise(200) + (passage if i % 3 == 0 else noise(400)) + noise(100) for i in range(900)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(900), pa.int64()), pa.array(texts, pa.binary())], names=["u", "raw"])
    sizes = {}
    for out in _spread(100, 16, 30, 1 << 30)(iter([batch])):
        for bucket, blob in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
            sizes[bucket] = sizes.get(bucket, 0) + len(blob)
    mean = sum(sizes.values()) / len(sizes)
    assert len(sizes) == 30 and max(sizes.values()) < 1.4 * mean
