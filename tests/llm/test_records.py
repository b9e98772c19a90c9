"""Exact copies, mixing, shards and packing: brute force and odd cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from drivegrid.llm import exact_copies, mixing, packing, shards

SF = "/root/testdata/sf0.001/documents.parquet"
WHITE = re.compile(r"[\x20\x09-\x0D]")


def rows(df):
    return [r.asDict() for r in df.collect()]


def brute_copies(docs):
    groups = defaultdict(list)
    for doc, text in docs:
        groups[WHITE.sub("", text or "")].append((-len(text or ""), doc is None, doc))
    best = {t: min(v)[2] for t, v in groups.items()}
    return Counter(
        (doc, best[t], len(groups[t]), doc == best[t], hashlib.sha256(t.encode()).hexdigest()) for doc, text in docs for t in [WHITE.sub("", text or "")]
    )


@pytest.mark.parametrize("which", ["odd", "table"])
def test_exact_copies_match_brute_force(spark, odd, which):
    df = odd if which == "odd" else spark.read.parquet(SF)
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows(exact_copies.exact_copies(df)))
    assert got == brute_copies([(r["doc_id"], r["text"]) for r in rows(df.select("doc_id", "text"))])


def test_exact_copies_keep_one_row_per_text(odd, empty):
    kept = exact_copies.keep_one(odd)
    assert kept.columns == odd.columns
    texts = [WHITE.sub("", r["text"] or "") for r in rows(kept)]
    assert len(texts) == len(set(texts)) == len({WHITE.sub("", r["text"] or "") for r in rows(odd)})
    assert exact_copies.exact_copies(empty).count() == 0 and exact_copies.keep_one(empty).count() == 0


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        left = total - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("which", ["odd", "table"])
def test_mix_meets_targets(spark, odd, which):
    df = odd if which == "odd" else spark.read.parquet(SF)
    plan = rows(mixing.mix(df, bucket_rows=4, fan_in=2))
    sizes = Counter()
    for r in rows(df.select("source", "text")):
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want = brute_targets(sizes)
    took, worst = Counter(), Counter()
    for r in plan:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["copies"] <= 3
        took[r["source"]] += r["copies"] * r["size"] * r["n_rows"]
        worst[r["source"]] = max(worst[r["source"]], r["size"] * r["n_rows"])
    assert sum(r["n_rows"] for r in plan) == df.count()
    for s in sizes:
        assert abs(took[s] - want[s]) <= worst[s]
    again = rows(mixing.mix(df.repartition(5), bucket_rows=4, fan_in=2))
    key = lambda r: str(sorted((k, str(v)) for k, v in r.items()))
    assert sorted(map(key, plan)) == sorted(map(key, again))


def test_mix_is_close_on_whole_buckets(spark):
    plan = rows(mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    took, target = Counter(), {}
    for r in plan:
        took[r["source"]] += r["copies"] * r["size"] * r["n_rows"]
        target[r["source"]] = r["target"]
    assert all(abs(took[s] - t) < 0.03 * t for s, t in target.items())


def test_rounding_keeps_expectation_and_mass():
    weight, p = np.array([9.0, 7, 5, 3, 2, 1, 0]), np.full(7, 0.37)
    total = np.zeros(7)
    for k in range(4000):
        out = mixing.round_bucket(weight, p, np.random.default_rng(k), last=True)
        assert set(out) <= {0.0, 1.0}
        assert abs((out * weight).sum() - (p * weight).sum()) < 9
        total += out
    assert np.allclose(total / 4000, 0.37, atol=0.03)
    mixed_p = np.array([0.2, 0.9, 0.4, 0.6, 0.1, 0.5, 0.3])
    total = sum(mixing.round_bucket(weight, mixed_p, np.random.default_rng(k), last=True) for k in range(4000))
    assert np.allclose(total / 4000, mixed_p, atol=0.03)


def test_mixed_repeats_rows(odd, empty):
    plan = {(r["doc_id"], r["source"], r["size"]): r["copies"] * r["n_rows"] for r in rows(mixing.mix(odd))}
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and out.count() == sum(plan.values())
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def brute_minimax(sizes, shards_):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, need, room = (low + high) // 2, 1, 0
        for s in sizes:
            if room + s > mid:
                need, room = need + 1, 0
            room += s
        low, high = (low, mid) if need <= shards_ else (mid + 1, high)
    return low


@pytest.mark.parametrize("which,width", [("odd", 1024), ("table", 7)])
def test_shards_are_minimax(spark, odd, which, width):
    df = odd if which == "odd" else spark.read.parquet(SF)
    out = rows(shards.shard(df, width=width))
    docs = rows(df.select("doc_id", "text"))
    assert len(out) == len(docs)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    slots = defaultdict(list)
    load, by_text = Counter(), defaultdict(set)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        by_text[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in by_text.values()) and set(load) <= set(range(8))
    groups = defaultdict(lambda: [2**63, 0])
    for r in docs:
        g = groups[r["text"] or ""]
        g[0], g[1] = min(g[0], -(2**63) if r["doc_id"] is None else r["doc_id"]), g[1] + len((r["text"] or "").encode()) + 1
    assert max(load.values()) <= brute_minimax([g[1] for g in sorted(groups.values())], 8)


def test_shards_of_nothing(empty):
    assert shards.shard(empty).collect() == []


def encode(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("which", ["odd", "table"])
def test_packing_restores_every_document(spark, odd, which):
    df = odd if which == "odd" else spark.read.parquet(SF)
    out = rows(packing.pack(df))
    want = Counter()
    for r in rows(df.select("doc_id", "text")):
        ids = np.array([*encode(r["text"] or ""), 0], dtype="<u4").tobytes()
        for k, (start, length) in enumerate(packing.cut_pieces(ids, 2048)):
            want[r["doc_id"], k, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    seqs = defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seqs) <= -(-sum(r["length"] for r in out) // 2048) * 1.05 + 2


def test_packing_plan_uses_every_piece():
    rng = np.random.default_rng(5)
    for _ in range(30):
        cap = int(rng.integers(8, 60))
        counts = {int(k): int(rng.integers(1, 400)) for k in rng.choice(np.arange(1, cap + 1), size=min(cap, 12), replace=False)}
        used = Counter()
        for key, times in packing.plan_packing(counts, cap):
            assert times > 0 and sum(key) <= cap
            for k in key:
                used[k] += times
        assert used == Counter(counts)
    # 6 = 3 + 3 and 10 = 6 + 2 + 1 + 1: no sequence has a gap
    assert packing.plan_packing({6: 1, 2: 1, 1: 2}, 10) == [((6, 2, 1, 1), 1)]


def test_packing_of_nothing(empty):
    assert packing.pack(empty).collect() == []


def test_cached_encoding_equals_the_library():
    enc = packing.encoder("byte_bpe_50k.tiktoken")
    for text in ["", " ", "  a", "a  b", "a \n b", "a\n b\n\n c ", "it's we'll", "x  y", "Ünï 漢字 🙂", "a\t b  ", "<|endoftext|> x"[13:], "\n \n x", "tab\t\tx  y   z"]:
        assert np.frombuffer(enc.encode(text), dtype="<u4").tolist() == encode(text), repr(text)


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|> x", "x  <|endoftext|>", "<|endoftext|><|endoftext|>\n y ", "<|endoftext| >", "it's<|endoftext|>'s"])
def test_added_tokens_have_their_ids(spark, text):
    ids = np.frombuffer(packing.encoder("byte_bpe_50k.tiktoken").encode(text), dtype="<u4").tolist()
    assert ids == encode(text)
    got = rows(packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert [(r["length"], r["ids_crc32"]) for r in got] == [(len(ids) + 1, zlib.crc32(np.array([*ids, 0], dtype="<u4").tobytes()))]


def test_columns_named_like_those_used_inside(spark):
    """Every name that an operator might use inside may be a column of the table."""
    from drivegrid.llm import jaccard_join

    names = ["_id", "_source", "_size", "_copies", "_words", "_nth", "_digest", "_rep", "_won_digest", "_won_id", "_gone", "_DIGEST_", "digest", "keep_id", "copies", "size"]
    cols = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    texts = ["one two three four five six seven", "one two  three four five six seven", "other words stand here in this text", None]
    df = spark.createDataFrame([(k, t, "en", "s", 1, *[f"{n}{k}" for n in names]) for k, t in enumerate(texts)], cols)
    whole = {tuple(r) for r in df.collect()}
    for kept in (exact_copies.keep_one(df), exact_copies.keep_one(df.unionByName(df)), jaccard_join.keep_one(df), mixing.mixed(df)):
        assert kept.columns == df.columns and {tuple(r) for r in kept.collect()} <= whole
    assert exact_copies.keep_one(df).count() == 3
