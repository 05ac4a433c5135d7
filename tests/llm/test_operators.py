"""Operators against brute force on small tables, and their defined results for odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import embedding_dedup, lm, order_minhash, packing, piece, quality, queries, recompress, sharding, substring, text, token_files, toxicity
from tests.oracle import connect, duck_rows, spark_rows

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, gid int, key string"


def words(t):
    return WORD.findall(t or "")


def prose(r, n, vocabulary=300):
    return " ".join(f"w{int(r.paretovariate(1.0)) % vocabulary}{r.choice(['', '', ',', '.'])}" for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, runs, nulls, empties, ties and a long text."""
    r = random.Random(11)
    base = [prose(r, n) for n in (0, 1, 4, 5, 12, 13, 14, 60, 120, 300, 300, 800)]
    passage = prose(r, 60)
    out = [None, "", "   \n\t", *base, base[8], base[8], base[9] + "\nend"]
    near = base[10].split()
    for k in range(4):
        copy = list(near)
        copy[20 * k + 5] = f"changed{k}"
        out.append(" ".join(copy))
    out += [prose(r, 30) + " " + passage + "\n" + prose(r, 40) for _ in range(3)]
    out += ["a " * 40, "b " + "a " * 25 + "c", "x y " * 20, prose(r, 20_000, 3000), "Ünïcode　ß É — 'tis 漢字 \x00 <|endoftext|> x"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 3 + 1, t, "en", f"src{k % 3}" if k % 5 else None, None, "clash", k, "clash") for k, t in enumerate(corpus())]
    rows += [rows[8], rows[20]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = defaultdict(list)
    for row in df.collect():
        out[row["doc_id"]].append(row)
    return out


def texts_of(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_words_and_hashes():
    t = [None, "", " a\x0bb c ", "ab ab", "É b"]
    raw, offsets = text.string_buffers(pa.array(t))
    w = text.cut_words(raw, offsets)
    got = [[w.raw[a:b].tobytes().decode() for a, b in zip(w.starts[f:g], w.ends[f:g])] for f, g in zip(w.first[:-1], w.first[1:])]
    assert got == [words(x) for x in t]
    assert w.hashes[w.first[3]] == w.hashes[w.first[3] + 1] != w.hashes[0]


def named_levels(sequences):
    """Levels of each word sequence, named by dictionaries that all sequences share."""
    ids, out = {}, []
    for seq in sequences:
        first, name = np.array([0, len(seq)]), lambda *key: ids.setdefault(key, len(ids) + 1)
        starts = recompress.runs(np.array(seq), first[:-1])
        names = np.array([name(0, seq[a], b - a) for a, b in zip(starts[:-1], starts[1:])])
        levels = [(names, starts)]
        for level in range(1, recompress.ROUNDS + 1):
            keep, joined = recompress.pairs(names, starts, first, level)
            names, starts = np.array([name(level, names[k], names[k + 1]) if j else names[k] for k, j in zip(keep, joined)]), np.append(starts[keep], starts[-1])
            levels.append((names, starts))
        out.append(levels)
    return out


def test_equal_windows_have_equal_symbols():
    r = random.Random(2)
    for _ in range(30):
        window = [r.randrange(4) for _ in range(13)]
        around = [[[r.randrange(4) for _ in range(r.randrange(20))] for _ in range(2)] for _ in range(6)]
        found = set()
        for (left, right), levels in zip(around, named_levels([a + window + b for a, b in around])):
            at = np.array([len(left)])
            ranges, good = recompress.certain(levels, at, 13)
            words = np.array(left + window + right) + 1000
            assert good.all() and all(0 <= low[0] - len(left) <= high[0] - len(left) <= 13 for low, high in ranges if high[0] > low[0])
            found.add(tuple(int(c[0]) for c in substring._columns(words, levels, ranges, at, 13)))
        assert len(found) == 1


def test_names_are_exact():
    """Buckets name what two documents have, by its bytes or its two names, and nothing else."""
    blob = lambda *lines: substring.zstandard.compress(b"\n".join(lines))
    named = lambda table, level: [substring._replies(table.filter(pa.array([g == k for g in table["gid"].to_pylist()])), level, 3).tolist() for k in (0, 5)]
    asked = substring._rows([(0, 1, substring.ASK, blob(b"0a", b"0a 2", b"0b", b"1c")), (5, 1, substring.ASK, blob(b"0a", b"0a 3", b"0d"))])
    x, y = named(substring._name_words()(asked), 0)
    assert x[0] == y[0] > 0 and x[3] > 0 and x[0] != x[3] and x[1] == x[2] == y[1] == y[2] == 0
    pairs = {0: [([1, 2, 7]), [2, 1, 7], [0, 0, 1]], 5: [[1, 2, 2], [2, 1, 2], [0, 0, 0]]}
    asked = substring._rows([(g, 1, substring.ASK, substring.pack(np.diff(p[0], prepend=0), *map(np.array, p[1:]))) for g, p in pairs.items()])
    x, y = named(substring._name_pairs(2)(asked), 2)
    assert x[0] == y[0] > 0 and x[1] == y[1] > 0 and x[2] > 0 and y[2] == 0 and len({*x}) == 3


def test_windows_of_one_hash_are_kept_apart():
    columns = [np.array([1, 2, 1, 2, 1]), np.array([5, 5, 5, 5, 6])]
    order, new = substring._equal_runs(np.zeros(5, np.uint64), lambda k, some: columns[k][some], 2)
    assert [sorted(x.tolist()) for x in np.split(order, np.flatnonzero(new)[1:])] in ([[0, 2], [1, 3], [4]], [[0, 2], [4], [1, 3]])


def test_substring_dedup_over_few_words(spark):
    """Runs, single-word texts and windows without a certain symbol, against brute force."""
    r = random.Random(5)
    texts = [" ".join(r.choice("ab") for _ in range(r.randrange(40))) for _ in range(60)]
    texts += [" ".join("a" * n) for n in (12, 13, 14, 30)] + [" ".join("a" * n + "b" * n) for n in (6, 7, 13, 20)] + [" ".join(f"w{k}" for k in range(40))] * 3
    rows = list(enumerate(texts))
    for group_bytes, bucket_bytes in ((1 << 20, 1 << 20), (200, 700)):
        got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=group_bytes, bucket_bytes=bucket_bytes)
        assert sorted((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got.collect()) == removed(rows)


def removed(rows, width=13):
    first = {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        w = words(t)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_embedding_dedup_in_rounds(spark, monkeypatch):
    """Stripes meet in rounds whose shuffles keep to a limit; each pair of tiles meets once."""
    r = np.random.default_rng(2)
    x = np.repeat(r.normal(size=(60, 6)), 5, axis=0) + r.normal(size=(300, 6)) * 0.12
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {k: int(n) - 1 for k, n in enumerate((unit @ unit.T >= 0.95).sum(axis=1))}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    keep, rounds = embedding_dedup.Scratch.keep, []
    monkeypatch.setattr(embedding_dedup.Scratch, "keep", lambda self, df, name: (rounds.append(name), keep(self, df, name))[1])
    for name, value in {"TILE": 20, "STRIPES": 5, "ROUND": 1}.items():
        monkeypatch.setattr(embedding_dedup, name, value)
    got = embedding_dedup.near_vectors(df).collect()
    assert {g["vec_id"]: g["n_links"] for g in got} == want
    assert 3 <= sum(n.startswith("links-") for n in rounds) <= 5


def test_substring_sends_only_windows_of_two_groups(spark, monkeypatch):
    """Short runs of few words repeat by chance, so that most windows have names; sent in full are those that another group has too."""
    r = random.Random(8)
    passage = [f"w{r.randrange(12)}" for _ in range(20)]
    texts = [[f"w{r.randrange(12)}" for _ in range(60)] for _ in range(150)]
    for k in (3, 90):
        texts[k][10:30] = passage
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    written, sent = substring._written, []

    def spy(scratch, df, name):
        out = written(scratch, df, name)
        if name == "windows":
            sent.extend(int(substring.unpack(bytes(x["blob"]))[0].sum()) for x in out.where(f"kind = {substring.ASK}").collect())
        return out

    monkeypatch.setattr(substring, "_written", spy)
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=4000, bucket_bytes=8000)
    assert {x["doc_id"]: x["n_removed"] for x in got.where("n_removed > 0").collect()} == {90: 20}
    assert sum(sent) == 16


def test_substring_rounds_read_the_last_round(spark, monkeypatch):
    """What a round leaves is read by the next one alone, not by all later ones, but for round 0's words and what says which symbols merged."""
    r = random.Random(11)
    texts = [" ".join(f"w{r.randrange(9)}" for _ in range(40)) for _ in range(30)]
    written, read = substring._written, {}

    def spy(scratch, df, name):
        root = scratch.root.rsplit("/", 1)[1]
        read[name] = {f.split(root)[1].split("/")[1] for f in df.inputFiles() if root in f}
        return written(scratch, df, name)

    monkeypatch.setattr(substring, "_written", spy)
    got = substring.substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), group_bytes=1500, bucket_bytes=2500)
    assert sorted((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got.collect()) == removed(list(enumerate(texts)))
    for k in range(1, recompress.ROUNDS + 1):
        assert read[f"round-{k}"] == {f"round-{k - 1}", f"names-{k - 1}"}
    assert {x for x in read["prints"] if x.startswith("names")} == {"names-0", f"names-{recompress.ROUNDS}"}


def test_substring_dedup_of_odd_words(spark):
    """Words longer than what is hashed at a time, with equal first bytes, of several bytes a character, with NULs; all kinds of white space; null, empty and blank texts."""
    r = random.Random(4)
    menu = ["x" * 200 + c for c in "abc"] + ["y" * 64, "y" * 65, "abcdefgh", "abcdefgh\0", "abcdefghi", "\0", "\0\0", "É", "日本語", "\u00a0", "1", "0", "0 1"]
    passage = [r.choice(menu[:-1]) for _ in range(30)]
    rows = [(k, "".join(w + r.choice([" ", "\t", "\n\n", "\x0b \r", "\x0c"]) for w in [r.choice(menu) for _ in range(r.randrange(30))] + passage[k % 9 : k % 23 + 5])) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " \n "), (103, " ".join(passage)), (104, "\n".join(["z" * 5000] * 20)), (105, " ".join(["z" * 5000] * 20))]
    for group_bytes, bucket_bytes in ((1 << 20, 1 << 20), (3000, 5000)):
        got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=group_bytes, bucket_bytes=bucket_bytes).collect()
        assert sorted((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got) == removed(rows)
        assert all(hashlib.sha256(x["kept_text"].encode()).hexdigest() == x["kept_sha256"] for x in got)


def test_messages_of_any_length():
    """Short arrays are sent as they are, long ones narrowed; both come back."""
    for n in (0, 1, substring._SHORT, substring._SHORT + 1, 5000):
        arrays = [np.arange(n) % 2 > 0, np.arange(n) - 3, np.arange(n) * (1 << 50) - 7, np.arange(n).astype(np.uint8)]
        back = substring.unpack(substring.pack(*arrays))
        assert all(x.dtype == np.int64 and (x == y).all() and len(x) == n for x, y in zip(back, arrays, strict=True))
        assert all((x == y).all() for x, y in zip(substring.unpack(substring.pack(*arrays), wide=False), arrays, strict=True))


def test_parts_grow_before_messages_do():
    """Up to a bound, parts grow with the table, so that messages, which number as groups times buckets, grow as it does."""
    sizes = [substring._dealt(gb << 30, substring.GROUP_BYTES, substring.BUCKET_BYTES) for gb in (0, 1, 2, 4, 48)]
    assert sizes[:2] == [(1, 1), (205, 128)] and sizes[2] == (256, 128) and sizes[3][1] == 128
    n, m = sizes[4]
    assert n * substring.GROUP_GROWTH * substring.GROUP_BYTES >= 48 << 30 and m * substring.BUCKET_GROWTH * substring.BUCKET_BYTES >= 48 << 30
    assert n * m < (48 << 30) ** 2 / substring.GROUP_BYTES / substring.BUCKET_BYTES / 7


def test_lines_of_keys():
    """Keys go to their buckets by their bytes alone and come back as they were, also from a slice."""
    words_ = [b"a", b"a 2", b"abcdefghi" * 30, b"abcdefghi" * 30 + b"j", b"\0", b"\0\0", "é".encode()]
    keys = pa.array(words_, pa.binary())
    head, own = text.span_hash(keys)
    assert len({*own.tolist()}) == len(keys) and all((x[2:] == y).all() for x, y in zip((head, own), text.span_hash(keys[2:])))
    assert [len(x) for x in text.span_hash(keys[:0])] == [0, 0]
    order, many = np.array([3, 0, 6, 1, 2, 5, 4]), np.array([1, 0, 0, 1, 1, 0, 1]) > 0
    blobs = [substring.zstandard.compress(x) for x in substring._lines(keys, many, order, np.array([0, 3, 3, 7])) if x]
    back, flags, counts = substring._read_lines(blobs)
    assert back.to_pylist() == [words_[k] for k in order] and flags.tolist() == many[order].tolist() and counts.tolist() == [3, 4]
    x = {g: substring._name_words()(substring._rows([(g, 1, substring.ASK, b) for g, b in enumerate(s)])) for g, s in enumerate((blobs + blobs, blobs[::-1] + blobs[::-1]))}
    names = [[substring._replies(t.filter(pa.array([g == k for g in t["gid"].to_pylist()])), 0, 3).tolist() for k in range(4)] for t in x.values()]
    assert names[0][:2] == names[0][2:] == names[1][:2][::-1] and min(map(min, names[0])) > 0


@pytest.mark.parametrize("group_bytes", [1 << 20, 3000])
def test_substring_dedup(docs, group_bytes):
    want = removed([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = substring.substring_dedup(docs, group_bytes=group_bytes)
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == want
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got.collect())


def test_vector_packing(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path).collect()
    want = {i: np.array([*tool.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts_of(docs).items()}
    covered = Counter()
    for r in rows:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        covered[r["doc_id"]] += r["length"]
    copies = Counter(r["doc_id"] for r in docs.collect())
    assert covered == {i: len(ids) * copies[i] for i, ids in want.items()}
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_place_holds_all_limits():
    r = np.random.default_rng(4)
    demand = np.stack([r.integers(1, 1100, 500), np.ones(500, int), r.integers(0, 600, 500)], axis=1)
    limits = np.array([1024, 6, 700])
    bins, order = packing.place(demand, limits)
    for b in np.unique(bins):
        own = demand[bins == b]
        assert len(own) == 1 or (own.sum(axis=0) <= limits).all()
        assert sorted(order[bins == b]) == list(range(len(own)))


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tool = Tokenizer.from_file(path)
    target = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs, target, path, 2, file_bytes=4000)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()))
    at, want = 0, []
    for i, t in rows:
        ids = np.array([*tool.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.digest(spark, target).collect()]
    assert sorted(got) == want
    assert token_files.read_tokens(spark, target, ["doc_id"], 10, 20).count() == sum(10 <= i <= 20 for i, _ in rows)


def test_kd_sharding(docs):
    rows = sharding.shard_documents(docs, 4).collect()
    sizes, t = Counter(), texts_of(docs)
    for r in rows:
        data = (t[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        sizes[r["shard"]] += r["size"]
    assert len(rows) == docs.count() and set(sizes) <= set(range(4))
    for k in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))


def test_shards_of_many_small_documents_weigh_alike(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(k, "x" * r.randint(0, 400), r.choice("ab"), f"s{k % 7}") for k in range(4000)], "doc_id long, text string, lang string, source string")
    sizes = [x["b"] for x in sharding.shard_documents(df).groupBy("shard").sum("size").toDF("shard", "b").collect()]
    assert len(sizes) == 16 and max(sizes) < 1.03 * min(sizes)


def test_quality_rules_equal_sql(spark, docs, small):
    import duckdb

    once = docs.dropDuplicates(["doc_id"]).select("doc_id", "text", "source")
    con = duckdb.connect()
    con.register("documents", once.toPandas())
    assert spark_rows(quality.quality_rules(once)) == duck_rows(con, quality.ORACLE_SQL)
    assert quality.quality_rules(docs).count() == docs.count()


def test_frequent_lines_reject_depleted_documents(spark):
    """Also where pages share their two longest lines; exact copies are one document."""
    r = random.Random(3)
    menu = [prose(r, 12) for _ in range(6)] + [prose(r, 55), prose(r, 55)]
    copy = "\n".join(prose(r, 15) for _ in range(8))
    rows = [(k, "\n".join([*menu, prose(r, 20)]), "h") for k in range(40)]
    rows += [(100 + k, copy, "h") for k in range(40)]
    rows += [(200 + k, "\n".join([menu[0], *(prose(r, 15) for _ in range(5))]), "h") for k in range(5)]
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[k]["kept"] for k in range(40))
    assert all(got[100 + k]["kept"] and not got[100 + k]["n_frequent_words"] for k in range(40))
    assert all(got[200 + k]["kept"] and got[200 + k]["n_frequent_words"] == 12 for k in range(5))


def shingles(t):
    w, out, seen = words(t), set(), Counter()
    for k in range(max(min(1, len(w)), len(w) - 4)):
        g = tuple(w[k : k + 5])
        out.add((g, seen[g]))
        seen[g] += 1
    return out


def test_order_minhash_classes(docs):
    t = texts_of(docs)
    sets = {i: shingles(x) for i, x in t.items()}
    up = {i: i for i in t}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(t)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = by_id(order_minhash.near_duplicates(docs))
    assert {i: {r["class_id"] for r in rows} for i, rows in got.items()} == {i: {root(i)} for i in ids}
    assert all(r["kept"] == (r["class_id"] == i) for i, rows in got.items() for r in rows)


def test_classes_of_a_chain_of_near_copies(spark):
    """Each links with its neighbours only; the smallest of a bucket alone wouldn't find all."""
    r = random.Random(8)
    w = prose(r, 400, 5000).split()
    rows = []
    for k in range(30):
        rows.append((1000 - k, " ".join(w)))
        for at in r.sample(range(400), 6):
            w[at] = f"n{k}x{at}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["class_id"] for r in order_minhash.near_duplicates(df).collect()} == {971}


def test_pieces_are_the_library_s(docs, spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    tool = sentencepiece.SentencePieceProcessor(model_file=path)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    r = random.Random(5)
    alphabet = [*"abcthe THE ▁  \n\té漢字ñ.,!'0123𝒳", *(tool.id_to_piece(r.randrange(300, 32000)).replace("▁", " ") for _ in range(400))]
    more = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(800)] + [" " * 37, "a" * 3000, "▁▁▁", "\n\n"]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(more)], "doc_id long, text string"))
    t = texts_of(df)
    for row in piece.piece_digests(df, path).collect():
        ids = [*tool.encode(t[row["doc_id"]] or ""), 2]
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(tool.decode(ids))), repr(t[row["doc_id"]])


def test_lm_base_and_normalisation(docs):
    got = lm.lm_scores(docs, rounds=1, share=4).collect()
    rows = docs.collect()
    low = lambda t: words((t or "").translate({c: c + 32 for c in range(65, 91)}))
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for r in rows if not out(r["doc_id"]) for w in low(r["text"]))
    ends = sum(not out(r["doc_id"]) for r in rows)
    total, below = counts.total() + ends, counts.total() + ends + 0.5 * (len(counts) + 2)
    t = texts_of(docs)
    for r in got:
        w = low(t[r["doc_id"]])
        base = sum(math.log10((counts[x] + 0.5) / below) for x in w) + math.log10((ends + 0.5) / below)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(r["doc_id"]), len(w) + 1, sum(counts[x] > 0 for x in w) + 1, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_recurrent_model_learns_and_sums_to_one():
    p = lm.initial(np.full(lm.SYMBOLS, 1 / lm.SYMBOLS))
    symbols = np.tile([5, 9, 700, 31], 3000)
    first = np.arange(0, len(symbols) + 1, 40)
    before = lm.log_probabilities(p, symbols, first, 0).mean()
    trained = lm.train(p, symbols, first, 0)
    assert lm.log_probabilities(trained, symbols, first, 0).mean() > before + 0.5
    state = np.random.default_rng(0).standard_normal((1, lm.HIDDEN)).astype(np.float32)
    log, _ = lm.output(trained, np.repeat(state, lm.SYMBOLS, axis=0), np.arange(lm.SYMBOLS))
    assert np.exp(log.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_gradients():
    r = np.random.default_rng(1)
    p = {k: (v + r.standard_normal(v.shape) * 0.1).astype(np.float64) for k, v in lm.initial(np.full(lm.SYMBOLS, 1 / lm.SYMBOLS)).items()}
    states, target = r.standard_normal((6, lm.HIDDEN)), r.integers(0, lm.SYMBOLS, 6)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    _, back = lm.output(p, states, target, grads, 1.0)
    moved = states.copy()
    moved[2, 3] += 1e-5
    assert (lm.output(p, states, target)[0].sum() - lm.output(p, moved, target)[0].sum()) / 1e-5 == pytest.approx(back[2, 3], abs=1e-3)


def test_score_does_not_depend_on_neighbours():
    """State is carried to a document's end and not beyond."""
    r = np.random.default_rng(2)
    p = {k: v + r.standard_normal(v.shape).astype(np.float32) * 0.2 for k, v in lm.initial(np.full(lm.SYMBOLS, 1 / lm.SYMBOLS)).items()}
    one = r.integers(0, lm.SYMBOLS, 150)
    alone = lm.log_probabilities(p, one, np.array([0, 150]), 0)
    other = r.integers(0, lm.SYMBOLS, 900)
    both = lm.log_probabilities(p, np.concatenate([other, one]), np.array([0, 500, 900, 1050]), 0)
    assert both[900:] == pytest.approx(alone, abs=1e-4)


def test_toxicity_on_planted_words(spark):
    r = random.Random(6)
    mean = ["idiotic", "scumbag", "moronic", "pathetico", "worthlessly"]
    docs, labels = [], []
    for k in range(900):
        w = prose(r, r.randint(20, 200), 2000).split()
        bad = k % 3 == 0
        for _ in range(3 * bad):
            w.insert(r.randrange(len(w)), r.choice(mean) + r.choice("xyz"))
        docs.append((k, " ".join(w)))
        labels.append((k, 1, int(bad)))
    docs += [(10_000, None), (10_001, "")]
    df, lb = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, lb).collect()}
    held = [k for k in range(900) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k in range(900))
    assert sum(got[k]["predicted"] for k in held if k % 3 == 0) >= 0.85 * sum(k % 3 == 0 for k in held)
    assert sum(got[k]["predicted"] for k in held if k % 3) <= 0.03 * sum(k % 3 > 0 for k in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert {r["score"] for r in toxicity.toxicity(df, lb.limit(0)).collect()} == {0.0}


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], "vec_id long, embedding array<float>, label int, rep string")


def test_near_vectors(spark):
    r = np.random.default_rng(7)
    centres = r.standard_normal((6, 16))
    rows = [(k, (centres[k % 6] + r.standard_normal(16) * 0.12).astype(np.float32).tolist()) for k in range(300)]
    rows += [(300 + k, rows[5][1]) for k in range(5)] + [(320, [2 * x for x in rows[5][1]])]
    odd = [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [None] * 16), (405, [float("inf")] + [1.0] * 15), (406, [1.0, 2.0])]
    got = {x["vec_id"]: x for x in embedding_dedup.near_vectors(vectors(spark, rows + odd)).collect()}
    v = np.array([x for _, x in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.array([i for i, _ in rows])
    link = v @ v.T >= 0.95
    np.fill_diagonal(link, False)
    component = ids.copy()
    while True:
        new = np.minimum(component, np.where(link, component[None, :], 1 << 60).min(axis=1))
        if (new == component).all():
            break
        component = new
    for k, i in enumerate(ids):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (link[k].sum(), component[k], component[k] == i)
    assert all((got[i]["n_links"], got[i]["component_id"]) == (0, i) for i, _ in odd)


def test_tiles_of_different_cells_meet(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 20)
    test_near_vectors(spark)


def test_empty_tables(spark, empty):
    byte, sp = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    for df in (
        substring.substring_dedup(empty),
        packing.pack_documents(empty, byte),
        sharding.shard_documents(empty),
        quality.quality_rules(empty),
        order_minhash.near_duplicates(empty),
        piece.piece_digests(empty, sp),
        toxicity.toxicity(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")),
        lm.lm_scores(empty, rounds=1),
        embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ):
        assert df.count() == 0


def test_near_vectors_of_doubles(spark):
    """array<double>: many, one, mixed lengths, 3-d, and vectors whose squares overflow or vanish."""
    r = np.random.default_rng(5)
    base = r.normal(size=(60, 16))
    rows = [(k, (base[k % 60] + r.normal(size=16) * 0.05 * (k // 60)).tolist()) for k in range(180)]
    rows += [(1000, [3.0, 4.0]), (1001, [3.0, 4.1]), (1002, [1.0, 2.0, 3.0]), (1003, [1.0, 2.0, 3.1]), (1004, [7.0])]
    rows += [(2000, [1e200, 1.0]), (2001, [1e200, 2.0]), (2002, [1e-200, 1e-200]), (2003, [2e-200, 2e-200]), (2004, [1e308, 1e308, 1e308]), (2005, [1.0, 1.0, 1.0]), (2006, [5e-324, 0.0])]
    rows += [(3000, [0.0, 0.0]), (3001, None), (3002, [math.nan, 1.0]), (3003, [math.inf, 1.0]), (3004, [None, 1.0]), (3005, [])]
    sound = {i: np.ldexp(np.array(v), -np.frexp(max(map(abs, v)))[1]) for i, v in rows if i < 3000}
    links = {i: {j for j, y in sound.items() if j != i and len(y) == len(x) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.95} for i, x in sound.items()}
    assert links[2000] >= {2001} and links[2002] >= {2003} and links[2004] >= {2005}
    got = {x["vec_id"]: x for x in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for i, v in rows:
        reach, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        assert tuple(got[i]) == (i, len(links.get(i, ())), min(reach), min(reach) == i)
    one = embedding_dedup.near_vectors(spark.createDataFrame([(5, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [tuple(x) for x in one] == [(5, 0, 5, True)]


def test_line_frequency_counts_documents(spark):
    """A hundred documents of equal text in one host make its lines frequent; as one document, with copies_as_one, they don't."""
    text = "\n".join(" ".join(f"w{k}x{j}" for j in range(8)) for k in range(9))
    df = spark.createDataFrame([(k, text, "h") for k in range(100)] + [(k, text, f"h{k}") for k in range(100, 120)], "doc_id long, text string, source string")
    by_id = quality.quality_rules(df).where("not kept").count()
    assert (by_id, quality.quality_rules(df, copies_as_one=True).where("not kept").count()) == (100, 0)


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c " * 20, None, None), (1, "a b c " * 20, None, None), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    assert substring.substring_dedup(df).count() == 3
    assert order_minhash.near_duplicates(df).where("doc_id is null and class_id is null and kept").count() == 2
    assert quality.quality_rules(df).count() == sharding.shard_documents(df).count() == 3
    assert packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json")).where("doc_id is null").count() == 2
    assert lm.lm_scores(df, rounds=1).count() == 3


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, small, name):
    assert spark_rows(queries.queries()[name](spark, small)) == duck_rows(connect(small), queries.oracle_sql()[name])


def test_every_training_document_is_trained_on(spark):
    """Documents of no round of one in 64 teach the model too."""
    ids = [r[0] for r in spark.range(400).where("pmod(xxhash64('round', id), 64) >= 4").collect()]
    df = spark.createDataFrame([(k, " ".join(f"w{(k + j) % 37}" for j in range(300))) for k in ids], "doc_id long, text string")
    got = [r for r in lm.lm_scores(df).collect() if r["held_out"]]
    assert np.mean([(r["score"] - r["base_score"]) / r["n_tokens"] for r in got]) > 0.3


def test_head_holds_the_most_frequent_words_whatever_their_counts(spark):
    counts = {h: c for h, c in enumerate([5000] * 8 + [4096] * 9 + [9000, 70_000, 3, 3, 1])}
    df = spark.createDataFrame([(h * 7 - 40, 0, c) for h, c in counts.items()], "h long, bucket int, c long")
    ranked = sorted(((c, h * 7 - 40) for h, c in counts.items()), reverse=True)
    for n in (1, 5, 10, 12, 20, 30):
        assert sorted(((r["c"], r["h"]) for r in lm._most_frequent(df, n, 10**6).collect()), reverse=True) == ranked[:n]


def test_kept_documents_lose_their_frequent_lines(spark):
    from quillon.llm import stages

    r = random.Random(4)
    body = [" ".join(f"v{r.randrange(10**6)}" for _ in range(30)) for _ in range(90)]
    rows = [(k, f"{body[3 * k]}\nHome   About us\n\n{body[3 * k + 1]}\n{body[3 * k + 2]}\n home about US ", "h", 7) for k in range(29)]
    rows += [(29, f"{body[87]}\nhome about us\n{body[88]}", "other", 7), (None, rows[0][1], "h", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: r for r in stages.quality_rules(spark, df, "").collect()}
    for k, text, host, _ in rows:
        cut = text if host == "other" else "\n".join(x for x in text.split("\n") if "bout" not in x)
        assert (got[k]["text"], got[k]["n_chars"]) == (cut, 7 if host == "other" else len(cut))


def test_evidence_asks_all_pairs():
    """The mean saving does not depend on which pairs know a word."""
    plain = toxicity._content([b"some ordinary words of no kind"], 1 << 10, 0)
    known = toxicity._content([b"some ordinary words scumbaggery"], 1 << 10, 0)
    pairs = [(plain, plain), (plain, plain), (plain, known), (plain, known)]
    one, other = (toxicity.Model((plain, plain), x).words([b"scumbaggery"])[0] for x in (pairs, pairs[::-1]))
    assert one == other > 0


def test_evidence_of_phrases():
    """A phrase that only toxic text repeats saves bytes, wherever it begins in the windows, and its words in another order don't."""
    r = random.Random(2)
    ordinary = [" ".join(f"w{r.randrange(300)}" for _ in range(60)).encode() for _ in range(60)]
    phrase = b"never trust those filthy neighbours again"
    mixed = b" neighbours never x those again y filthy trust"
    ordinary = [t + mixed for t in ordinary]
    toxic = [b" ".join([*t.split()[:20], phrase, *t.split()[20:]]) for t in ordinary[:30]]
    kinds = toxicity._Sequences(ordinary[30:]), toxicity._Sequences(toxic)
    assert phrase in toxicity._repeated(*kinds[::-1], None) and phrase not in toxicity._repeated(*kinds, None)
    model = toxicity.Model(toxicity._dictionaries(*kinds, b" ".join(ordinary[30:])), [])
    model.words = lambda vocabulary, without=-1, seen=None: np.zeros(len(vocabulary))
    for k in range(5):
        with_it = b" ".join([*ordinary[40].split()[: 10 + k], phrase, *ordinary[40].split()[10 + k :]])
        x = model.features(*toxicity._joined([with_it, ordinary[40], b"", b"a"]))
        assert x[0, 0] >= 3 > x[1, 0] and not x[2:, :-2].any()


@pytest.mark.parametrize("length", [4, 8])
def test_toxicity_of_phrases_of_common_words(spark, length):
    """The label depends on a phrase alone; its words are as frequent, one by one, in ordinary text."""
    r = random.Random(length)
    phrases = [[f"w{r.randrange(20, 120)}" for _ in range(length)] for _ in range(3)]
    docs, labels = [], []
    for k in range(1200):
        w = prose(r, r.randint(40, 250), 2000).split()
        bad = k % 3 == 0
        for _ in range(2):
            some = list(r.choice(phrases))
            at = r.randrange(len(w))
            if bad:
                w[at:at] = some
            else:
                for x in some:
                    w.insert(r.randrange(len(w)), x)
        docs.append((k, " ".join(w)))
        labels.append((k, 1, int(bad)))
    df, lb = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(df, lb).where("held_out").collect()}
    bad = [x for k, x in got.items() if k % 3 == 0]
    clean = [x for k, x in got.items() if k % 3]
    assert len(bad) > 100 and sum(bad) >= 0.8 * len(bad) and sum(clean) < 0.05 * len(clean)


THUE = ["ab"[bin(k).count("1") % 2] for k in range(1024)]
OTHER = ["ba"[bin(k).count("1") % 2] for k in range(1024)]


def test_texts_whose_polynomial_hashes_are_equal(spark):
    """A Thue-Morse text and its complement, as letters of one word and as words."""
    from tokenizers import Tokenizer

    texts = ["".join(THUE), "".join(OTHER), " ".join(THUE), " ".join(OTHER)]
    df = spark.createDataFrame([(k, t, None, None) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1)
    w = text.cut_words(*text.string_buffers(pa.array(texts[:2])))
    assert w.hashes[0] != w.hashes[1]
    path = public_tokenizers.path("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    for r in packing.pack_documents(df, path).collect():
        ids = np.array([*tool.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0], "<u4")
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in piece.piece_digests(df, public_tokenizers.path("piece_bpe_32k.model")).collect():
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(sp.encode(texts[r["doc_id"]])).encode()).hexdigest()
    assert {r["doc_id"]: r["copy_of"] for r in order_minhash.near_duplicates(df).collect()} == {k: k for k in range(4)}
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.substring_dedup(df).collect()) == removed(list(enumerate(texts)))


def test_large_ids(spark):
    near = 1 << 62
    r = random.Random(1)
    one = prose(r, 100)
    df = spark.createDataFrame([(near + k, one) for k in range(6)] + [(near + 10 + k, one + f" end{k}") for k in range(4)], "doc_id long, text string")
    assert {x["class_id"] for x in order_minhash.near_duplicates(df).collect()} == {near}
    v = [[1.0, 0.01 * k] for k in range(5)]
    got = embedding_dedup.near_vectors(vectors(spark, [(near + k, x) for k, x in enumerate(v)])).collect()
    assert {x["component_id"] for x in got} == {near}


def test_two_vectors_of_one_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [0.02, 1.0])]
    got = sorted((x["vec_id"], x["n_links"], x["component_id"]) for x in embedding_dedup.near_vectors(vectors(spark, rows)).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)]


def test_starts_of_rows_of_one_id(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    r = random.Random(4)
    df = spark.createDataFrame([(7, prose(r, r.randint(1, 30))) for _ in range(9)] + [(None, "x y"), (8, None)], "doc_id long, text string")
    target = f"file://{tmp_path}/one"
    token_files.write_tokens(df, target, path, 2)
    stored = token_files.read_tokens(spark, target).orderBy("part", "ordinal").collect()
    at, want = 0, []
    for x in stored:
        want.append((x["doc_id"], at, x["n_tokens"], zlib.crc32(np.array(x["tokens"], "<u4").tobytes())))
        at += x["n_tokens"]
    assert sorted(map(str, map(tuple, token_files.digest(spark, target).collect()))) == sorted(map(str, want))
    assert [x["doc_id"] for x in stored][0] is None


def test_pages_and_row_groups_of_token_files(spark, tmp_path):
    """Token pages are dictionary coded, metadata is delta coded, row groups have a bounded size and page indexes."""
    import pyarrow.parquet as pq

    r = random.Random(9)
    df = spark.createDataFrame([(k, prose(r, 400)) for k in range(600)], "doc_id long, text string")
    target = tmp_path / "pages"
    token_files.write_tokens(df, f"file://{target}", public_tokenizers.path("word_bpe_49k.json"), 2)
    seen = 0
    for path in sorted(target.glob("*.parquet")):
        meta = pq.ParquetFile(path).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            assert group.total_byte_size <= 2 * token_files.ROW_GROUP_BYTES
            columns = {group.column(c).path_in_schema.split(".")[0]: group.column(c) for c in range(group.num_columns)}
            assert "RLE_DICTIONARY" in columns["tokens"].encodings and columns["tokens"].has_dictionary_page
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings or columns["doc_id"].has_dictionary_page
            assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index
            seen += group.num_rows
    assert seen == 600


def test_loss_limit_binds(spark):
    """Loss-bearing ids are those after the first line; sequences are closed by their limit before they are full."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    r = random.Random(5)
    rows = [(k, (prose(r, 12) + "\n") * (k % 2) + prose(r, r.randint(5, 900))) for k in range(300)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    tokens, segments, loss = (Counter() for _ in range(3))
    for x in got:
        tokens[x["sequence_id"]] += x["length"]
        loss[x["sequence_id"]] += x["loss_tokens"]
        segments[x["sequence_id"]] += 1
    assert max(tokens.values()) <= packing.TOKENS and max(loss.values()) <= packing.LOSS and max(segments.values()) <= packing.SEGMENTS
    assert any(loss[k] == packing.LOSS and tokens[k] < packing.TOKENS for k in tokens)
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(path)
    for k, t in rows[:40]:
        ids = tool.encode(t, add_special_tokens=False).ids
        prompt = len(tool.encode(t[: t.index("\n") + 1], add_special_tokens=False).ids) if "\n" in t else 0
        assert sum(x["loss_tokens"] for x in got if x["doc_id"] == k) == len(ids) - prompt
    assert sum(tokens.values()) > 0.97 * packing.TOKENS * len(tokens)


def test_shards_of_documents(spark, small):
    """Equal texts lie together and shards weigh alike, also where single documents and copies are heavy."""
    from quillon.llm.spark_util import documents

    docs = documents(spark, small)
    rows = sharding.shard_documents(docs).join(docs.selectExpr("doc_id", "coalesce(text, '') as text"), "doc_id").collect()
    of, sizes = defaultdict(set), Counter()
    for x in rows:
        of[x["text"]].add(x["shard"])
        sizes[x["shard"]] += x["size"]
    assert all(len(s) == 1 for s in of.values())
    assert len(sizes) == 16 and max(sizes.values()) < 1.03 * min(sizes.values())


def test_stage_rows_of_one_id_and_clashing_columns(spark):
    from quillon.llm import stages

    r = random.Random(7)
    passage = prose(r, 60)
    rows = [(1, passage, "c", 1), (2, "x " + passage, "c", 2), (2, prose(r, 5), "c", 3), (2, "x " + passage, "c", 4), (None, "y z", "c", 5), (3, None, "c", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text string, n_chars long")
    got = stages.substrings(spark, df, "")
    assert got.columns == df.columns
    assert sorted((str(x["doc_id"]), x["text"]) for x in got.collect() if x["text"]) == sorted([("1", passage), ("2", "x"), ("2", "x"), ("2", rows[2][1]), ("None", "y z")])
    assert got.count() == 6


def test_recall_of_order_minhash(spark):
    """All pairs of similarity 0.8 and more of 240 near copies, against brute force."""
    r = random.Random(12)
    rows = []
    for k in range(60):
        w = prose(r, r.randint(40, 200), 4000).split()
        for v in range(4):
            copy = list(w)
            for at in r.sample(range(len(w)), int(len(w) * 0.012 * v)):
                copy[at] = f"new{k}x{v}x{at}"
            rows.append((len(rows), " ".join(copy)))
    sets = [shingles(t) for _, t in rows]
    got = {x["doc_id"]: x["class_id"] for x in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if a // 4 == b // 4 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) > 100 and sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)


def test_order_minhash_sends_kmers_only_where_keys_leave_a_pair_open(spark):
    """Pairs below the threshold meet in several buckets, where one comparison with the smallest settles all."""
    r = random.Random(31)
    rows = []
    for _ in range(60):
        w = prose(r, 3000, 5000).split()
        rows.append((len(rows), " ".join(w)))
        for at in r.sample(range(3000), 220):
            w[at] = f"n{at}"
        rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).persist()
    df.count()
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = written()
    got = order_minhash.near_duplicates(df).collect()
    assert {x["doc_id"]: x["class_id"] for x in got} == {k: k for k in range(len(rows))}
    assert written() - before < 2 * sum(len(t) for _, t in rows)
    df.unpersist()


def test_order_minhash_in_blocks_and_rounds(spark, monkeypatch):
    """Buckets of many blocks, k-mers sent by many rounds: the classes of brute force."""
    r = random.Random(32)
    rows = []
    for _ in range(6):
        w = prose(r, 120, 4000).split()
        for v in range(12):
            copy = list(w)
            for at in r.sample(range(len(w)), v % 5):
                copy[at] = f"m{at}x{v}"
            rows.append((len(rows), " ".join(copy[: 120 - v])))
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for b in range(len(rows)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    rounds = set()
    keep = order_minhash.Scratch.keep
    monkeypatch.setattr(order_minhash.Scratch, "keep", lambda self, table, name: (rounds.add(name), keep(self, table, name))[1])
    for name, value in (("BLOCK", 3), ("ROUND_BYTES", 1 << 14), ("ROUND_WORD", 0)):
        monkeypatch.setattr(order_minhash, name, value)
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {"tested-1", "open-1", "more-1"} <= rounds
    assert {x["doc_id"]: x["class_id"] for x in got} == {k: root(k) for k in range(len(rows))}


def test_order_minhash_sends_batches_bounded_by_bytes(spark, monkeypatch):
    """Few rows of long texts are several batches, so that a worker's memory doesn't follow a row's length; settings are as before then."""
    most, key = 1 << 18, "spark.sql.execution.arrow.maxBytesPerBatch"
    r, before, sketch, verify = random.Random(8), spark.conf.get(key), order_minhash._sketch, order_minhash._verify
    long = [prose(r, 3000) for _ in range(60)]
    rows = [(k, long[k]) for k in range(60)] + [(100 + k, long[k] + " one more end") for k in range(60)]

    def small(run):
        def bounded(batches):
            def each():
                for batch in batches:
                    assert batch.nbytes < 2 * most or batch.num_rows == 1, (batch.num_rows, batch.nbytes)
                    yield batch

            yield from run(each())

        return bounded

    monkeypatch.setattr(order_minhash, "BATCH_BYTES", most)
    monkeypatch.setattr(order_minhash, "_sketch", small(sketch))
    monkeypatch.setattr(order_minhash, "_verify", small(verify))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {x["doc_id"]: x["class_id"] for x in order_minhash.near_duplicates(df).collect()} == {k: k % 100 for k, _ in rows}
    assert spark.conf.get(key) == before
