"""Packing, encoding, language model, sharding, exact and near dedup, secrets on small odd tables and the smallest benchmark."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortwise.llm import bpe, exact_dedup, language_model, minhash, packing, queries, secrets, sharding


def tokenizer(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def texts_of(documents):
    return [(r.doc_id, r.text or "") for r in documents.select("doc_id", "text").collect()]


def check_pieces(pieces, texts):
    t = tokenizer("byte_bpe_50k.json")
    ids = collections.defaultdict(list)
    for name, text in texts:
        ids[name].append(t.encode(text, add_special_tokens=False).ids + [1])
    for _, group in pieces.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert list(group.offset) == [0, *np.cumsum(group.length)[:-1]] and group.length.sum() <= 2048
    for p in pieces.itertuples():
        name = None if math.isnan(p.doc_id) else int(p.doc_id)
        crcs = [zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) for x in ids[name] if len(x) == p.doc_tokens]
        assert p.ids_crc32 in crcs
    assert pieces.length.sum() == sum(len(x) for group in ids.values() for x in group)


def test_packing_odd(odd):
    check_pieces(packing.pack(odd, public_tokenizers.path("byte_bpe_50k.json")).toPandas(), texts_of(odd))
    assert packing.pack(odd.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_packing_benchmark(spark, folder):
    pieces = queries.op1_packing(spark, folder).toPandas()
    check_pieces(pieces, texts_of(spark.read.parquet(f"{folder}/documents.parquet")))
    assert pieces.length.sum() / (2048 * pieces.sequence_id.nunique()) > 0.98


def test_greedy_balances_cost():
    pieces = packing.assign([5, 2048, 1000, 1000, 40, 3, 4100], packing.Packing())
    assert sum(n for _, _, n, _, _ in pieces) == 5 + 2048 + 2000 + 43 + 4100
    assert {s for d, _, _, s, _ in pieces if d == 2} != {s for d, _, _, s, _ in pieces if d == 3}


def test_bpe(spark, odd, folder):
    t = tokenizer("word_bpe_49k.json")
    path = public_tokenizers.path("word_bpe_49k.json")
    for documents in (odd, spark.read.parquet(f"{folder}/documents.parquet")):
        expected = collections.Counter()
        for name, text in texts_of(documents):
            ids = t.encode(text, add_special_tokens=False).ids
            shown = hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
            expected[name, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), shown] += 1
        assert collections.Counter(map(tuple, bpe.encode_digests(documents, path).collect())) == expected
    whole = {r.doc_id: r.ids for r in bpe.encode_documents(odd, path).collect()}
    assert whole[7] == t.encode("Word", add_special_tokens=False).ids
    assert bpe.encode_digests(odd.limit(0), path).count() == 0


def test_sharding(odd):
    records = sharding.document_records(odd)
    placed = sharding.shuffle_into_shards(records.withColumn("shard", F.lit(9)), 5, ["doc_id", "text_crc32", "size"], "size").toPandas()
    again = sharding.shuffle_into_shards(records, 5, ["doc_id", "text_crc32", "size"], "size").toPandas()
    assert len(placed) == odd.count()
    counts = placed.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and len(counts) == 5
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in placed.groupby("shard"))
    key = ["shard", "slot", "text_crc32"]
    assert sorted(map(tuple, placed[key].to_numpy())) == sorted(map(tuple, again[key].to_numpy()))
    assert sharding.shuffle_into_shards(records.limit(0), 5, ["doc_id"], "size").count() == 0


def test_shards_hold_whole_documents(spark, odd, folder, tmp_path, monkeypatch):
    """Every column of every document is in the files, and the query's rows are those of the files."""
    written = sharding.shard_documents(odd, 5, str(tmp_path / "odd"))
    columns = [c for c in odd.columns if c != "shard"]
    assert collections.Counter(map(tuple, written.select(columns).collect())) == collections.Counter(map(tuple, odd.select(columns).collect()))
    again = sharding.shard_documents(odd.repartition(4), 5, str(tmp_path / "again"))
    assert sorted(map(repr, written.select("shard", "slot", "text").collect())) == sorted(map(repr, again.select("shard", "slot", "text").collect()))
    assert sorted(p.name for p in (tmp_path / "odd").glob("shard=*")) == [f"shard={k}" for k in range(5)]
    for file in (tmp_path / "odd").glob("shard=*/*.parquet"):
        slots = [r.slot for r in spark.read.parquet(str(file)).collect()]
        assert slots == sorted(slots)
    assert sharding.shard_documents(odd.limit(0), 5, str(tmp_path / "none")).count() == 0
    monkeypatch.setattr(queries, "shared_folder", lambda spark: str(tmp_path / "query"))
    rows = queries.op4_sharding(spark, folder).collect()
    files = spark.read.parquet(str(next((tmp_path / "query").glob("shards-*")))).collect()
    assert {(r.shard, r.slot): (r.doc_id, r.size, r.text_crc32) for r in rows} == {(f.shard, f.slot): (f.doc_id, len((f.text or "").encode()) + 16, zlib.crc32((f.text or "").encode())) for f in files}
    assert sorted(texts_of(spark.read.parquet(f"{folder}/documents.parquet"))) == sorted((f.doc_id, f.text or "") for f in files)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda text: F.substring(F.sha2(text, 256), 1, 0)])
def test_exact_dedup(odd, digest):
    """A digest that never tells texts apart gives the same classes: the bytes decide."""
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(odd, digest).collect())
    classes = collections.defaultdict(list)
    for name, text in texts_of(odd):
        classes[text].append(name)
    expected = collections.Counter()
    for names in classes.values():
        keep = max((n for n in names if n is not None), default=None)
        for n in names:
            expected[n, keep, len(names), n == keep] += 1
    assert got == expected


def test_exact_stage(odd):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted({t for _, t in texts_of(odd)})
    assert exact_dedup.drop_copies(odd.limit(0)).count() == 0


def brute_components(texts, shingle, percent):
    def shingles(text):
        w = text.encode().lower().split()
        return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()

    sets = [shingles(t) for _, t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    out = collections.Counter()
    for i, (name, _) in enumerate(texts):
        names = [texts[k][0] for k in range(len(texts)) if root[k] == root[i] and texts[k][0] is not None]
        out[name, len(sets[i]), (min(names) if names else None) if sets[i] else name] += 1
    return out


def test_one_row_of_each_group_stays(spark, odd):
    """Repeated and null ids: rows are told apart by id and text."""
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen"
    near = "one two three four five six seven eight nine"
    rows = [(3, a), (5, a), (5, b), (None, b), (None, b), (None, "alone in the world with five words"), (7, b), (7, b), (8, None), (8, ""), (None, None), (2, near), (3, a)]
    table = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, component int, key string, stay_id int")
    kept = minhash.drop_near_copies(table)
    assert kept.columns == table.columns
    expected = [(2, near), (5, b), (None, "alone in the world with five words"), (8, None), (8, ""), (None, None)]
    assert sorted(map(repr, map(tuple, kept.select("doc_id", "text").collect()))) == sorted(map(repr, expected))
    nulls = spark.createDataFrame([(None, a), (None, a), (None, b)], "doc_id long, text string")
    assert sorted(r.text for r in minhash.drop_near_copies(nulls).collect()) == sorted([a, b])
    copies = spark.createDataFrame([(4, a, k) for k in range(5)], "doc_id long, text string, extra int")
    assert minhash.drop_near_copies(copies).count() == 1
    assert minhash.drop_near_copies(odd.limit(0)).count() == 0


@pytest.mark.parametrize("least, most", [(1 << 16, 1 << 27), (64, 64)])
def test_marks_never_lose_a_wanted_document(spark, monkeypatch, least, most):
    monkeypatch.setattr(minhash, "_LEAST_BITS", least)
    monkeypatch.setattr(minhash, "_MOST_BITS", most)
    keys = spark.createDataFrame([(f"k{i}",) for i in range(3000)], "key string")
    marks = minhash._marks(keys)
    places = [r[0] for r in keys.select(F.pmod(F.xxhash64("key"), F.lit(8 * len(marks)))).collect()]
    assert all(marks[p >> 3] >> (p & 7) & 1 for p in places)
    assert np.unpackbits(marks).sum() == len(set(places))


def test_a_large_group_is_dealt_in_small_blocks(spark, monkeypatch):
    """1500 near copies beside 1500 plain texts: no task's group holds a tenth of the rows shipped."""
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*base[:k % 60], f"x{k}", *base[k % 60 :]])) for k in range(1500)]
    rows += [(5000 + k, " ".join(f"p{k % 700}y{j}" if j else f"q{k}" for j in range(12))) for k in range(1500)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = []
    deal = minhash._deal

    def counted(members):
        dealt = deal(members)
        sizes.append(sorted((r["count"] for r in dealt.groupBy(*minhash._DEALT).count().collect()), reverse=True))
        return dealt

    monkeypatch.setattr(minhash, "_deal", counted)
    got = minhash.near_duplicates(documents, minhash.NearDuplicates(2)).collect()
    assert len({r.component_id for r in got if r.doc_id < 1500}) == 1
    assert sizes and all(not s or s[0] <= max(2 * 1.5 * minhash._BLOCK_MEMBERS, sum(s) / 10) for s in sizes)


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates(spark, odd, folder, shingle):
    spec = minhash.NearDuplicates(shingle)
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    base = [f"w{i}" for i in range(120)]
    chain = [(10_000 + k, " ".join(base[4 * k :] + [f"v{k}x{j}" for j in range(4 * k)])) for k in range(12)]
    documents = documents.unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(chain, "doc_id long, text string"))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents, spec).collect())
    assert got == brute_components(texts_of(documents), shingle, 80)
    assert minhash.near_duplicates(odd.limit(0), spec).count() == 0


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Long lists split into block pairs find what whole lists find."""
    monkeypatch.setattr(minhash, "_BLOCK_MEMBERS", 5)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(40):
        words = list(base)
        for at in rng.choice(100, size=int(rng.integers(0, 14)), replace=False):
            words[at] = f"x{rng.integers(1_000_000)}"
        rows.append((k, " ".join(words)))
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents, minhash.NearDuplicates(2)).collect())
    assert got == brute_components(rows, 2, 80)


def test_secrets(odd):
    reports = collections.defaultdict(list)
    for r in secrets.report(secrets.scan(odd)).collect():
        reports[r.doc_id].append(r.spans)
    patterns = [
        ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile("[0-9a-f]+"), 0, 24),
    ]
    for name, text in texts_of(odd):
        found = [(m.start(), k, m.end(), kind) for k, (kind, p, g, least) in enumerate(patterns) for m in p.finditer(text) if len(m[g]) >= least]
        assert ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)) in reports[name]
    assert len(reports[8][0].split(",")) == 4
    masked = secrets.masked(odd)
    assert masked.columns == odd.columns and masked.count() == odd.count()
    text = masked.where("doc_id = 8").first().text
    assert "hunter22x" not in text and "[access]" in text and "[hex]" in text and "secret=12345" in text
    assert secrets.report(secrets.scan(odd.limit(0))).count() == 0


def test_running_sum_spans_blocks(spark):
    text = " ".join(f"token=abcdef{i}" for i in range(300))
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.start, s.end) for s in row["assign"]] == [(m.start(), m.end()) for m in re.finditer(r"token=abcdef\d+", text)]


@pytest.mark.parametrize("frequent", [1 << 20, 3])
def test_language_model(odd, frequent):
    model = language_model.train(odd.where("doc_id <> 8"), frequent_words=frequent)
    got = collections.defaultdict(list)
    for r in language_model.score(odd, model).collect():
        got[r.doc_id].append(r)
    training = [t.encode().lower().split() + [None] for n, t in texts_of(odd) if n is not None and n != 8]
    counts = collections.Counter(w for t in training for w in t)
    total, different = sum(counts.values()), len(counts)
    for name, text in texts_of(odd):
        tokens = text.encode().lower().split() + [None]
        base = sum(math.log10((counts[w] + 1) / (total + different + 1)) for w in tokens)
        r = next(r for r in got[name] if r.n_tokens == len(tokens))
        assert r.train_tokens == total and r.n_known == sum(counts[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(base) and r.score < 0
    empty = language_model.train(odd.limit(0))
    assert empty.tokens == 0 and language_model.score(odd, empty).count() == odd.count()


def test_language_model_beats_its_base(spark, folder):
    scored = queries.op7_language_model(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert scored[1] > scored[0]


def test_filter_never_forgets():
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    counts = rng.integers(1, 1000, len(grams))
    regions, bits = 8, 64 * 400
    region = language_model._region(grams, regions).astype(int)
    filled = [language_model.fill_region(grams[region == k], counts[region == k], bits)[0] for k in range(regions)]
    held = language_model.Filter(regions, bits, np.concatenate(filled))
    found = language_model.quantised_counts(held, grams)
    assert (found >= 2.0 ** np.floor(np.log2(counts)) * 0.99).all()
    others = rng.integers(0, 2**63, 5000).astype(np.uint64)
    assert (language_model.quantised_counts(held, others) > 0).mean() < 0.5


def test_filter_keeps_its_bits_beyond_the_broadcast(spark, odd, folder):
    """A filter over the broadcast bound has the same bits as one below it: level false hits, equal scores."""
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).repartition(3)
    training = documents.where(~language_model.held_out(F.col("doc_id")))
    small, large = language_model.train(training, max_filter_bytes=500), language_model.train(training)
    columns = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got, expected = (sorted(map(repr, map(tuple, language_model.score(documents, m).select(columns).withColumns({c: F.round(c, 6) for c in columns[4:]}).collect()))) for m in (small, large))
    assert got == expected
    assert small.filter.regions * small.filter.region_bits == large.filter.regions * large.filter.region_bits > 8 * 500
    others = np.random.default_rng(4).integers(0, 2**63, 20_000).astype(np.uint64)
    hits = [language_model.quantised_counts(language_model.Filter(1, small.filter.region_bits, np.frombuffer(r.bits, np.uint8)), others) > 0 for r in small.filter.table.collect()]
    assert abs(np.mean(hits) - (language_model.quantised_counts(large.filter, others) > 0).mean()) < 0.01 and np.mean(hits) < 0.1
    assert language_model.score(odd.limit(0), small).count() == 0
