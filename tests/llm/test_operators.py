"""Corpus operators against brute force, round trips and edge cases."""

import collections
import glob
import hashlib
import random
import re
import struct
import time
import timeit
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import components, jaccard, lines, media, mixing, packing, quality, secrets, tokens, topk, toxicity
from tarn.llm.common import Workspace, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a very long text, repeated rows, ties, and columns whose names clash."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 6), (None, "one two three four five", "en", None, 24), (4, "x " * 60_000, "en", "b", 120_000), (5, "y" * 90_000, None, "b", 90_000)]
    rows += [(6, "same text here and there", "en", "c", 24)] * 3 + [(7, "same text here and there", "en", "c", 24)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("size", "node", "key", "a", "b", "id", "label", "row", "text_key", "target", "rank", "score", "blank", "kept"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


class Union(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


# 1 -------------------------------------------------------------------------------------------------------------------------
def test_secrets_match_the_rules(spark, docs):
    extra = ["api_key = 'abcdef' secret=token:abcdef AKIA" + "A" * 16 + "b " + "f" * 24 + "g", "PASSWORD: hunter2 paſſword=abcdefg toKen=ab", "é password=éabcdefgh token  :  \"abcdef\""]
    df = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(extra)], "doc_id bigint, text string"))
    got = {r.doc_id: r for r in secrets.report(secrets.findings_by_path(df, secrets.scan_new(df), ["doc_id"])).collect()}
    for i, t in texts(df).items():
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].base_sha256) == secrets.digest(t)
        base = [x for x in got[i].spans.split(",") if x.split(":")[0] in secrets.BASE]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == got[i].base_sha256


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "ledger")
    v1 = spark.createDataFrame([("a", 1, "token=abcdefgh"), ("b", 1, "nothing"), ("c", 1, "token=abcdefgh")], "path string, version int, text string")
    assert secrets.update_ledger(v1, path).count() == 2
    v2 = v1.unionAll(spark.createDataFrame([("a", 2, "secret=12345678"), ("d", 1, "nothing")], v1.schema))
    ledger = secrets.update_ledger(v2, path)
    assert ledger.count() == 3 and secrets.scan_new(v2, ledger).count() == 0
    assert secrets.scan_new(v2, ledger.withColumn("rule_version", F.lit("old"))).count() == 3
    found = secrets.findings_by_path(v2, ledger, ["path", "version"]).where("size(findings) > 0").select("path", "version").collect()
    assert sorted(map(tuple, found)) == [("a", 1), ("a", 2), ("c", 1)]


def test_own_rules_have_no_caps():
    kinds = lambda t: [(k, t[a:b]) for k, a, b in secrets.find(t) if k not in secrets.BASE]
    url = "https://user:" + "p" * 200 + "@host"
    assert kinds(f"see {url}") == [("url", url[:-4])]
    assert kinds("9http://a:bcd@x ://a:bcd@x 99://a:bcd@x") == [("url", "http://a:bcd@")]
    jwt = "eyJ" + "a" * 300 + ".eyJ" + "b" * 20 + "." + "c" * 43
    assert kinds(f"Bearer {jwt};") == [("jwt", jwt)]
    assert kinds("-----BEGIN " + "VERY " * 20 + "PRIVATE KEY-----")[0][0] == "pem"


@pytest.mark.parametrize("part", ["eyJ", "a://", "a://b:", "-----BEGIN ", "password=", "ghp_"])
def test_scan_time_is_linear(part):
    best = lambda n: min(timeit.repeat(lambda: secrets.find(part * n), number=1, repeat=3))
    assert best(40_000) < 4 * best(20_000) + 0.05


# 2 -------------------------------------------------------------------------------------------------------------------------
def test_token_counts_match_the_tokenizer(docs):
    import sentencepiece
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = tokenizer_path(tokens.VOCABULARY)
    sp, c = sentencepiece.SentencePieceProcessor(model_file=path), tokens.load(path)
    vocabulary = [(p, s if p in c.pieces else 0.0) for p, s in ((sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()))]
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts(docs).items()}
    for x in ("", " ", "  a  b ", "日本語 テキスト 🎉", "\n\tfoo", "▁x", "a" * 500):
        assert c.count(x) == len(t.encode(x, add_special_tokens=False).ids), x


# 3 -------------------------------------------------------------------------------------------------------------------------
def check_packing(df, window=packing.WINDOW):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(packing.VOCABULARY))
    want = collections.defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        want[r.doc_id].append([*t.encode(r.text or "", add_special_tokens=False).ids, packing.END])
    rows = packing.pack(df, window).collect()
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    for i, ids in want.items():
        assert sum(r.length for r in pieces[i]) == sum(map(len, ids))
        for r in pieces[i]:
            assert any(len(x) == r.doc_tokens and zlib.crc32(np.asarray(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids)
        if len(ids) == 1:
            at = 0
            for r in sorted(pieces[i], key=lambda r: r.start):
                assert r.start == at
                at += r.length
    return 1 - sum(r.length for r in rows) / (window * max(1, len(sequences)))


def test_packing(docs, odd):
    assert check_packing(docs.repartition(1)) < 0.03
    check_packing(odd, 512)


def test_chunk_ids_match_the_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizer_path(packing.VOCABULARY)
    t, c = Tokenizer.from_file(path), packing.ChunkTokenizer(path)
    for x in ("a<|endoftext|>b c", "İstanbul ﬁ é  x y \x1c z don't 'S 12 ab12", "ΑΣ ΑΣ. x́ ́y", "\x85a\x85 b", "ab. a'b. a'. can't. ʼn ß ẞ ǅ ..., 1.5", "  ", "a b c"):
        assert c.ids(x) == np.asarray(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x


@pytest.mark.parametrize("seed", range(3))
def test_differencing(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 500) for _ in range(200)]
    place, sums = packing.differencing(sizes, 25)
    own = np.bincount(place, sizes, 25)
    assert sorted(own) == sorted(sums) and sums.max() - sums.min() < 60
    fit = packing.partition(sizes, 2048)
    assert np.bincount(fit, sizes).max() <= 2048 and fit.max() + 1 <= -(-sum(sizes) // 2048) + 2
    assert packing.partition([2048, 2048, 1], 2048).max() == 2


# 4 -------------------------------------------------------------------------------------------------------------------------
def shares(sizes, weights=mixing.WEIGHTS, most=3):
    """By repeated resharing, as the contract says it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        target = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return fixed | target
        fixed |= {s: most * sizes[s] for s in over}


def test_mixing(spark, docs, odd):
    for df in (docs, odd):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count()
        if df is docs:
            again = mixing.mix(df.repartition(5)).collect()
            assert sorted((str(r.doc_id), r.taken) for r in rows) == sorted((str(r.doc_id), r.taken) for r in again)
            mixed = rows
    sources = {(r.doc_id, r.text): r.source for r in docs.select("doc_id", "text", "source").collect()}
    by_id = {k[0]: s for k, s in sources.items()}
    size = {k[0]: len(re.findall(r"[^\x20\x09-\x0D]+", k[1] or "")) for k in sources}
    total = collections.Counter()
    for i, n in size.items():
        total[by_id[i]] += n
    want = shares(total)
    taken, most = collections.Counter(), collections.Counter()
    for r in mixed:
        s = by_id[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], total[s]) and r.target == pytest.approx(want[s])
        assert r.taken <= 3 * r.size
        taken[s] += r.taken
        most[s] = max(most[s], r.size)
    assert all(abs(taken[s] - want[s]) <= most[s] for s in total)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 50, None: 3}, {"a": 0, "b": 5}, {"x": 7}, {"a": 1, "b": 1, "c": 1, "d": 100, "e": 1, "f": 900}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(shares(sizes))


def test_mixture_repeats_rows(spark, odd):
    want = collections.Counter()
    for r in mixing.mix(odd).collect():
        want[r.doc_id] += r.copies
    got = mixing.mixture(odd)
    assert got.columns == odd.columns
    assert collections.Counter(r.doc_id for r in got.collect()) == collections.Counter({k: v for k, v in want.items() if v})


def test_stages_leave_few_rows(spark, docs):
    """Of their own tables, the Jaccard stage leaves two and the mix three; its rows to look up are far fewer than documents, so texts don't move."""
    def left(stage):
        mark = Workspace.opened(spark)
        stage(docs)
        found = {p.rpartition("/")[2].partition("-")[2]: p for base in Workspace._all(spark)[mark:] for p in glob.glob(f"{base.removeprefix('file://')}/*")}
        rows = {k: spark.read.parquet(p).count() for k, p in found.items() if k == "copies"}
        Workspace.close_since(spark, mark)
        return set(found), rows

    assert left(jaccard.one_of_each)[0] == {"out", "again"}
    tables, rows = left(mixing.mixture)
    assert tables == {"copies", "targets", "edges"} and rows["copies"] < docs.count() / 5


# 5 -------------------------------------------------------------------------------------------------------------------------
def test_topk(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-3, 4, (120, 6)).astype(float) / 256
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(200, None), (250, [float("nan")] * 6), (300, [None] + [0.0] * 5), (350, [float("inf")] * 6), (400, [1e-3, 0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    df = df.where(topk.usable(F.col("embedding"))).withColumn("embedding", topk.quantized(F.col("embedding")))
    got = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    q = {i: np.floor(256 * np.array(x)).astype(int) for i, x in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)}
    dot = lambda a, b: int((a[: min(len(a), len(b))] * b[: min(len(a), len(b))]).sum())
    assert set(got) == {0, 50, 100, 400}
    for i in got:
        assert got[i] == sorted(((dot(q[i], x), j) for j, x in q.items() if j != i), key=lambda p: (-p[0], p[1]))[:5]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


# 6 -------------------------------------------------------------------------------------------------------------------------
def brute_components(rows, k=4, percent=85):
    sets = {}
    for i, t in rows.items():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    u, where = Union(), collections.defaultdict(list)
    for i in sorted(sets):
        u.find(i)
        for j, n in collections.Counter(j for x in sets[i] for j in where[x]).items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                u.join(i, j)
        for x in sets[i]:
            where[x].append(i)
    return {i: (len(s), u.find(i)) for i, s in sets.items()}


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"new{rng.randrange(10**6)}"
        elif kind == 1 and len(words) > 2:
            del words[at]
        else:
            words.insert(at, f"ins{rng.randrange(10**6)}")
    return words


def test_jaccard_join_is_exact(spark):
    rng = random.Random(1)
    rows, n = {}, 0
    for length in (5, 9, 11, 14, 20, 31, 60, 120, 240):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        for _ in range(14 if length < 200 else 40):
            rows[n], n = " ".join(edited(base, rng, rng.randrange(0, max(2, length // 12)))), n + 1
        for _ in range(5):  # cut copies
            at = rng.randrange(max(1, length // 5))
            rows[n], n = " ".join(base[at:]), n + 1
    rows |= {n: "A b C d", n + 1: "a B c D", n + 2: "", n + 3: "one", n + 4: "one"}
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == brute_components(rows)
    five = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df, 5, 80).collect()}
    assert five == {i: c for i, (_, c) in brute_components(rows, 5, 80).items()}


def test_jaccard_of_one_large_group(spark):
    """Near copies of one text, about as far from one another as a link may be, with some that few others are near to."""
    rng = random.Random(77)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    near = [edited(base, rng, 2) for _ in range(3)]
    rows = {i: " ".join(edited(rng.choice(near), rng, rng.randrange(2, 5))) for i in range(700)}
    rows |= {700 + i: " ".join(edited(rows[rng.randrange(700)].split(), rng, 2)) for i in range(200)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")).collect()}
    assert got == brute_components(rows)
    assert len({c for _, c in got.values()}) > 3


def test_pigeonhole_covers_every_similar_pair():
    rng = np.random.default_rng(6)
    bands = jaccard.Bands()
    for n in [*range(6, 40), 77, 150, 400, 1000]:
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for _ in range(12):
            keep = s[rng.random(len(s)) > rng.random() * 0.14]
            t = np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, max(1, n // 8) + 1)).astype(np.uint64)]))
            common = len(np.intersect1d(s, t))
            if 100 * common >= 85 * (len(s) + len(t) - common) and common < max(len(s), len(t)):
                assert len(np.intersect1d(bands.keys(s), bands.keys(t))), (n, len(t), common)


def test_pigeonhole_covers_pairs_as_far_apart_as_links_may_be():
    """Pairs at the threshold, of both settings, whether or not single shingles are indexed."""
    rng = np.random.default_rng(7)
    for percent in (80, 85):
        bands = jaccard.Bands(percent)
        for n in [*range(3, 60, 2), 113, 176, 277, 432, 600, 925, 1500]:
            for _ in range(6):
                s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
                most = bands.differences(len(s), len(s))
                gone = rng.integers(0, most + 1)
                t = np.unique(np.concatenate([rng.permutation(s)[gone:], rng.integers(0, 2**63, most - gone).astype(np.uint64) * np.uint64(2) + np.uint64(1)]))
                common = len(np.intersect1d(s, t))
                if 100 * common >= percent * (len(s) + len(t) - common) and common < max(len(s), len(t)):
                    assert len(np.intersect1d(bands.keys(s), bands.keys(t))), (percent, n, len(t), common)


def test_sets_with_single_shingles_in_common_share_few_keys():
    """Sets of 900 that share 2 % of their shingles with others: a subset of one shingle is no key where larger ones prove enough."""
    rng = np.random.default_rng(8)
    bands, pool = jaccard.Bands(80), rng.integers(0, 2**63, 2_000).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(np.concatenate([rng.choice(pool, 18, replace=False), rng.integers(0, 2**63, 882).astype(np.uint64) * np.uint64(2)])) for _ in range(300)]
    found = collections.Counter(k for s in sets for k in bands.keys(s).tolist())
    assert sum(n for n in found.values() if n > 1) < 100


def test_one_of_each(spark, odd):
    got = jaccard.one_of_each(odd)
    assert got.columns == odd.columns
    assert collections.Counter(r.doc_id for r in got.collect()) == {1: 1, 2: 1, 3: 1, None: 1, 4: 1, 5: 1, 6: 1}


# 7 -------------------------------------------------------------------------------------------------------------------------
def test_media_round_trip(docs, odd):
    for df in (docs, odd):
        seen = texts(df)
        for r in media.digest_media(media.store_texts(df)).collect():
            raw = (seen[r.doc_id] or "").encode()
            raw += b"\0" * (-len(raw) % 64 or 64 * (not raw))
            assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
            assert r.n_bytes == len((seen[r.doc_id] or "").encode()) and r.media_bytes == len(raw) + 44


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_sniffing(spark):
    import io
    import zipfile

    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\0;"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    pdf = b"%PDF-1.4 x startxref\n0\n%%EOF"
    whole = {"audio/wav": media.to_wav(b"abc"), "image/png": png(), "image/gif": gif, "image/bmp": bmp, "application/zip": z.getvalue(), "application/pdf": pdf, "image/jpeg": b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x02xx\xff\xd9"}
    rows = [(k, v, "text/plain") for k, v in whole.items()] + [("bad", b"GIF89a but text, BM too", "image/gif"), ("inside", b"text " + png() + b" more " + gif, "text/plain"), ("null", None, "x"), ("empty", b"", "x")]
    got = {r.key: r for r in media.type_media(spark.createDataFrame(rows, "key string, m binary, d string"), "key", "m", "d").collect()}
    for k, v in whole.items():
        assert (got[k].format, got[k].bytes, got[k].corrected) == (k, len(v), True)
        assert media.sniff(v[:-1], media.automaton()) == [] or k in ("application/pdf",)
    assert got["bad"].format == "application/octet-stream" and got["bad"].corrected and not got["bad"].carved
    assert [(c.start, c.format, bytes(c.media)) for c in got["inside"].carved] == [(5, "image/png", png()), (11 + len(png()), "image/gif", gif)]
    assert got["null"].format is None and got["empty"].format == "application/octet-stream"


@pytest.mark.parametrize("part", [b"%PDF-", b"\xff\xd8\xff\xda\0\2", b"PK\x03\x04", b"%PDF- startxref ", b"fLaC", b"RIFF"])
def test_sniffing_time_is_linear(part):
    a = media.automaton()
    best = lambda n: min(timeit.repeat(lambda: media.sniff(part * n, a), number=1, repeat=3))
    assert best(40_000) < 4 * best(20_000) + 0.05


def test_sniffing_of_ends():
    a = media.automaton()
    pdf = b"%PDF-1.4 x startxref\n0\n%%EOF"
    assert [x[:2] for x in media.sniff(pdf + b" update startxref\n9\n%%EOF", a)] == [(0, len(pdf) + 25)]
    assert [x[:2] for x in media.sniff(pdf + b"  " + pdf, a)] == [(0, len(pdf)), (len(pdf) + 2, len(pdf))]
    head = struct.pack(">HH", 4096, 4096) + bytes(6) + (44_100 << 12).to_bytes(4, "big") + bytes(4) + bytes(16)
    flac = b"fLaC\x80\0\0\x22" + head + b"\xff\xf8frame"
    assert media.sniff(flac, a) == [(0, len(flac), "audio/flac")]
    assert media.sniff(b"fLaC" + b"\0\0\0\x22" + bytes(60), a) == []


# 8 and 10 ------------------------------------------------------------------------------------------------------------------
def labelled(spark, n=400):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(n):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        words = [f"word{rng.randrange(300)}" for _ in range(rng.randrange(20, 120))]
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["nastyone", "vilest", "Horrid,"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"), {i: (q, t) for i, q, t in marks}


def test_quality_held_out(spark):
    df, labels, truth = labelled(spark)
    rows = quality.report(df, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id][0] for r in held) / len(held) > 0.95


def test_toxicity_held_out_and_spans(spark):
    df, labels, truth = labelled(spark)
    rows = toxicity.report(df, labels).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.predicted == truth[r.doc_id][1] for r in held) / len(held) > 0.95
    seen = texts(df)
    spans = [seen[r.doc_id][s.start : s.stop] for r in rows for s in r.spans]
    assert spans and all(re.search("nasty|vilest|horrid", s.lower()) for s in spans)


def test_toxicity_scores_by_hand(spark):
    """Scores and spans from the model's weights, one document after the other."""
    df, labels, _ = labelled(spark, 200)
    df = df.unionAll(spark.createDataFrame([(900, None), (901, ""), (902, "vilest " * 3000), (903, "a" * 100 + " nastyone")], df.schema))
    model = toxicity.train(df, labels)
    a = np.exp(model.trans)
    for r in toxicity.score(df, model).join(df, "doc_id").collect():
        words = list(re.finditer(r"[^\x20\x09-\x0D]+", r.text or ""))
        e = np.array([[model.emission(w[0].encode())] for w in words]).reshape(-1, 1)
        p = toxicity.marginals(e, np.ones(e.shape, bool), a)[0][:, 0]
        total, top = p.sum(), np.sort(np.append(p, [0.0, 0.0]))[::-1]
        x = [np.log1p(total), top[0], top[1], min(1.0, 20 * total / max(1, len(p)))]
        assert r.score == pytest.approx(1 / (1 + np.exp(-(model.layer[0] + np.dot(x, model.layer[1:])))))
        hot = {i for i in np.flatnonzero(p > 0.5)}
        assert [(s.start, s.stop) for s in r.spans] == [(words[i].start(), words[max(k for k in range(i, len(words)) if set(range(i, k + 1)) <= hot)].end()) for i in sorted(hot) if i - 1 not in hot]
        assert r.n_toxic == len(hot)


def test_toxicity_sample_is_bounded_in_tokens(spark):
    df, labels, truth = labelled(spark)
    sizes = spark.createDataFrame([(i, i % 2, 10) for i in range(40)] + [(99, 0, 10**9)], "doc_id bigint, y int, n bigint")
    kept = toxicity.bounded(sizes, 55)
    assert sum(i % 2 for i in kept) == 5 and len(kept) == 10 and kept == toxicity.bounded(sizes.orderBy(F.rand()), 55)
    rows = toxicity.score(df, toxicity.train(df, labels, tokens=3000)).collect()
    assert sum((r.score >= 0.7) == truth[r.doc_id][1] for r in rows) / len(rows) > 0.9


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    e, a = rng.random((5, 2)) * 3, rng.random((2, 2)) + 0.1
    mask = np.array([[True, True]] * 4 + [[True, False]])
    p, _, _ = toxicity.marginals(e, mask, a)
    for c, n in ((0, 5), (1, 4)):
        total, hit = 0.0, np.zeros(n)
        for bits in range(1 << n):
            y = [bits >> i & 1 for i in range(n)]
            w = np.prod([a[[0, *y][i], y[i]] * (e[i, c] if y[i] else 1) for i in range(n)])
            total += w
            hit += w * np.array(y)
        assert np.allclose(p[:n, c], hit / total)


def test_labels_that_teach_nothing(spark, odd):
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality.report(odd, empty).collect()} == {0.5}
    assert {r.score for r in toxicity.report(odd, empty).collect()} == {0.0}
    nulls = spark.createDataFrame([(None, 1, 1), (4, None, None), (5, 0, 0)], empty.schema)
    assert quality.report(odd, nulls).count() == toxicity.report(odd, nulls).count() == odd.count()


# 9 -------------------------------------------------------------------------------------------------------------------------
def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 90))) for _ in range(40)]
    pool = base + [" ".join(edited(b.split(), rng, 1)) for b in base for _ in range(4)] + [b.upper() + "!" for b in base[:10]] + ["", "...", "--"]
    rows = {i: "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 8))) for i in range(80)}
    rows[80] = "\n".join(["big " + "word " * 20_000, "big " + "word " * 20_000 + "end"])
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string").repartition(3)
    got = {(r.doc_id, r.line_no) for r in lines.occurrences_to_drop(df).collect()}
    norms = lines.lines_of(df.where("doc_id < 80")).select("norm").distinct().withColumn("node", F.xxhash64("norm"))
    hashed = {r.norm: r.simhash for r in lines.simhashes(norms).join(norms, "node").collect()}
    norm = lambda s: re.sub(r"[\W_]+", " ", s.lower()).strip()
    where = collections.defaultdict(list)
    for i, t in sorted(rows.items()):
        for k, line in enumerate(t.split("\n")):
            if norm(line):
                where[norm(line)].append((i, k))
    u, names = Union(), list(where)
    for i, a in enumerate(names):
        for j, b in enumerate(names[:i]):
            x, y = hashed.get(a), hashed.get(b)
            if x is not None and y is not None and (x ^ y).bit_count() <= lines.MAX_BITS and levenshtein(a, b) <= int(max(len(a), len(b)) * 0.1 + 1e-9):
                u.join(i, j)
    groups = collections.defaultdict(list)
    for i, a in enumerate(names):
        groups[u.find(i)] += where[a]
    want = {o for g in groups.values() for o in sorted(g)[1:]}
    assert {o for o in got if o[0] < 80} == {o for o in want if o[0] < 80}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_simhash_is_a_majority(spark):
    """Of the word pairs' hashes, bit by bit."""
    df = spark.createDataFrame([(1, "a b c d e f g a b"), (2, "one")], "doc_id bigint, text string")
    got = {r.node: r.simhash for r in lines.simhashes(df.toDF("node", "norm")).collect()}
    for r in df.collect():
        w = r.text.split()
        pairs = spark.createDataFrame([(x, y) for x, y in zip(w, [*w[1:], None], strict=True)], "a string, b string").select(F.xxhash64("a", "b")).collect()
        votes = np.array([[(p[0] & (1 << 64) - 1) >> i & 1 for i in range(60)] for p in pairs]).sum(0)
        want = sum(1 << (i % 4 * 15 + i // 4) for i in range(60) if 2 * votes[i] > len(pairs))
        assert got[r.doc_id] == want


def test_line_dedup_recall_by_edit_similarity_alone(spark):
    """Lines of the usual length with one word changed, added or taken out, against edit similarity without any other filter."""
    rng = random.Random(31)
    pairs = []
    while len(pairs) < 300:
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 45))]
        at = rng.randrange(len(words))
        other = words[:at] + rng.choice([[f"v{rng.randrange(3000)}"], [], [words[at], f"v{rng.randrange(3000)}"]]) + words[at + 1 :]
        a, b = " ".join(words), " ".join(other)
        if levenshtein(a, b) <= int(max(len(a), len(b)) * 0.1 + 1e-9):
            pairs.append((a, b))
    rows = [(2 * i + j, line) for i, p in enumerate(pairs) for j, line in enumerate(p)]
    got = {r.doc_id for r in lines.occurrences_to_drop(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got <= {2 * i + 1 for i in range(len(pairs))}
    assert len(got) >= 0.9 * len(pairs)


def test_pieces_do_not_change_what_is_alike(spark):
    """Long lines, just within and beyond the bound, with changes spread, shifted and swapped."""
    rng = random.Random(4)
    rows = []
    for length in (60, 700, 3000):
        base = "".join(rng.choice("abcdefgh ") for _ in range(length))
        for n in (0, length // 20, length // 10, length // 9, length // 7):
            spread = list(base)
            for at in rng.sample(range(length), n):
                spread[at] = "z"
            rows += [(base, "".join(spread)), (base, "y" * n + base), (base, base[n:] + base[:n])]
    df = spark.createDataFrame([(x, y, max(len(x), len(y)) // 10) for x, y in rows], "x string, y string, most int")
    for r in df.select("*", lines.alike("x", "y", "most").alias("alike"), F.expr("levenshtein(x, y)").alias("far")).collect():
        assert r.alike == (r.far <= r.most)


def test_bounds_decide_most_that_is_alike(spark):
    """Lines with words changed, added and removed all along, so that no piece keeps its place: decided without the distance of wholes."""
    rng = random.Random(61)
    rows = []
    for n in (60, 300, 4000):
        words = [f"w{rng.randrange(3000)}" for _ in range(n)]
        for _ in range(20):
            rows.append((" ".join(words), " ".join(edited(words, rng, n // 25))))
    df = spark.createDataFrame([(x, y, max(len(x), len(y)) // 10) for x, y in rows], "x string, y string, most int")
    got = df.select(F.expr(lines.bounded("x", "y", "most")).alias("v"), F.expr("length(x) > 10000 OR levenshtein(x, y) <= most").alias("alike")).collect()
    assert all(r.alike for r in got if r.v.near)
    assert sum(bool(r.v.near) for r in got) >= 0.9 * len(got)


def test_bounds_find_their_place_after_a_passage(spark):
    """Lines of which one has a passage more, longer than anchors are off by: decided without the distance of wholes."""
    rng = random.Random(71)
    rows = []
    for n in (100, 160):
        for _ in range(10):
            words = [f"w{rng.randrange(3000)}" for _ in range(n)]
            more = [f"v{rng.randrange(3000)}" for _ in range(n // 14)]
            rows.append((" ".join(words[:1] + ["a"] + words[1:]), " ".join(words[: n // 3] + more + words[n // 3 :] + ["b"])))
    df = spark.createDataFrame([(x, y, max(len(x), len(y)) // 10) for x, y in rows], "x string, y string, most int")
    got = df.select(F.expr(lines.bounded("x", "y", "most")).alias("v"), F.expr("levenshtein(x, y) <= most").alias("alike")).collect()
    assert all(r.alike for r in got)
    assert all(r.v.near for r in got)


def test_wholes_are_compared_after_the_last_round_alone(spark, monkeypatch):
    """Pairs that bounds leave open and other links join are never compared as wholes, and those compared are written down before."""
    written, compared, table, linked_wholes = [], [], Workspace.table, lines.linked_wholes

    def named(self, df, name="t"):
        written.append(name)
        return table(self, df, name)

    def counted(ws, pairs, norms):
        compared.append(pairs.count())
        return linked_wholes(ws, pairs, norms)

    monkeypatch.setattr(Workspace, "table", named)
    monkeypatch.setattr(lines, "linked_wholes", counted)
    # bounds say nothing of a pair with an odd sum
    monkeypatch.setattr(lines, "tested", lambda pairs, norms: pairs.selectExpr("a", "b", "CASE WHEN pmod(a + b, 2) = 0 THEN true END AS near"))
    members = spark.createDataFrame([(k, n, 30, 0) for k in (1, 2) for n in range(6)] + [(3, 6, 30, 0), (3, 9, 30, 0)], "key bigint, node bigint, chars int, simhash bigint")
    norms = spark.createDataFrame([(n, "one line of words in some order"[: 31 - n % 2]) for n in range(7)] + [(9, "x" * 30)], "node bigint, norm string")
    got = {r.node: r.label for r in lines.labels_by_rounds(Workspace(spark, "test"), members, norms).collect()}
    assert got == dict.fromkeys(range(6), 0)
    assert len(compared) == 1 and compared[0] <= 10 and written.count("wholes") == 1


def test_line_dedup_leaves_one_table(spark):
    """What a job wrote for itself is gone when its result is there to be read."""
    opened = Workspace.opened(spark)
    df = spark.createDataFrame([(i, f"one line of many words that is much like others {i}\nsecond line") for i in range(6)], "doc_id bigint, text string")
    out = lines.clean(df)
    left = Workspace._all(spark)[opened:]
    assert out.count() == 6
    assert sum(len(glob.glob(f"{base.removeprefix('file://')}/*")) for base in left) == 1


def test_members_of_many_keys_meet_once(spark):
    """Ten members that share twelve keys, three of them hubs of all keys and one of some: each meets a hub in one row."""
    known = spark.createDataFrame([(k, n, 100, 0, n) for k in range(12) for n in range(10)] + [(99, 3, 100, 0, 3), (99, 4, 100, 0, 4)], "key bigint, node bigint, chars int, simhash bigint, label bigint")
    hubs = lines.as_hubs(known.where("node < 3 OR node = 3 AND key IN (5, 7, 99)"))
    rows = [(r.node, r.hub) for r in lines.met(known, hubs, True).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(n, h) for n in range(10) for h in range(4) if n != h}
    assert set(rows) == {(r.node, r.hub) for r in lines.met(known, hubs, False).collect()}


def test_hot_key_of_lines_that_are_not_alike(spark):
    """Lines that share all the keys of one half and are linked in two groups alone."""
    rng = random.Random(12)
    start = " ".join(f"s{i}" for i in range(10))
    rows = [(i, f"{start} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(10))) for i in range(300)]
    rows += [(1000 + i, rows[7][1][:-1] + c) for i, c in enumerate("xyz")] + [(2000 + i, rows[200][1] + f" {c}") for i, c in enumerate("xy")]
    got = {r.doc_id for r in lines.occurrences_to_drop(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1000, 1001, 1002, 2000, 2001}


def test_hot_key_is_compared_to_its_end(spark):
    """Lines that share one half, and pairs among them that have no other key in common: the first hubs of that key link nothing."""
    rng = random.Random(45)
    start = [f"s{i}" for i in range(10)]
    rows = []
    for i in range(300):
        words = [f"word{rng.randrange(10**6)}" for _ in range(10)]
        other = [w[:-1] + "x" if j % 3 == 0 else w for j, w in enumerate(words)]
        rows += [(i, " ".join(start + words)), (1000 + i, " ".join(start + other))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    cut = lines.lines_of(df)
    keys = {r.doc_id: set(r.k) for r in lines.sketched(cut).select("doc_id", lines.join_keys().alias("k")).collect()}
    hashed = {r.node: r.simhash for r in lines.simhashes(cut.select(F.col("doc_id").alias("node"), "norm")).collect()}
    hot = set.intersection(*keys.values())
    near = {i for i in range(300) if keys[i] & keys[1000 + i] == hot and (hashed[i] ^ hashed[1000 + i]).bit_count() <= lines.MAX_BITS}
    assert hot and len(near) > 2
    near = sorted(near)[:2]
    got = {r.doc_id for r in lines.occurrences_to_drop(df.where(F.col("doc_id").isin(*near, *(1000 + i for i in near)) | (F.col("doc_id") < 300))).collect()}
    assert got == {1000 + i for i in near}


def test_cores_keep_distances(spark):
    """Of equal strings, empty ones, and strings that overlap themselves."""
    rows = [("", ""), ("a", ""), ("ab", "ab"), ("aaaa", "aa"), ("abcabcabc", "abcabc"), ("same start x same end", "same start yy same end"), ("xäöy" * 40, "xäöy" * 20 + "ö" + "xäöy" * 20)]
    df = spark.createDataFrame(rows, "x string, y string").withColumn("c", F.expr(lines.core("x", "y")))
    for r in df.select("*", F.expr("levenshtein(x, y)").alias("far"), F.expr("levenshtein(c.x, c.y)").alias("core")).collect():
        assert r.core == r.far


def test_clean_keeps_first_lines(spark, odd):
    df = spark.createDataFrame([(1, "Hello there\n\nunique one\nhello, THERE!"), (2, "hello there"), (3, None)], "doc_id bigint, text string").withColumn("dropped", F.lit("clash")).withColumn("id", F.lit(0))
    got = lines.clean(df.drop("dropped"))
    assert {r.doc_id: r.text for r in got.collect()} == {1: "Hello there\n\nunique one", 2: "", 3: None}
    assert {r.doc_id for r in lines.clean(df.drop("dropped"), keep_emptied=False).collect()} == {1, 3}
    kept = lines.clean(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()


# Components ----------------------------------------------------------------------------------------------------------------
def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(7, 7)]
    u = Union()
    for a, b in pairs:
        if a != b:
            u.join(a, b)
    ws = Workspace(spark, "test")
    got = {r.node: r.label for r in components.components(ws, spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: u.find(x) for x in list(u)}


# Workspace -----------------------------------------------------------------------------------------------------------------
def test_tables_leave_no_shuffle_files(spark):
    """They would lie on the executors' disks until the driver's garbage is collected."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("|").split("|") if f.endswith(".data")}
    before, ws = files(), Workspace(spark, "test")
    counted = ws.table(spark.range(1000).groupBy(F.col("id") % 10).count())
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before
    assert counted.count() == 10


# All -----------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", ["odd", "none"])
def test_edge_cases(spark, name, request):
    df = request.getfixturevalue(name)
    n = df.count()
    assert secrets.report(secrets.findings_by_path(df, secrets.scan_new(df), ["doc_id"])).count() == n
    assert tokens.count_tokens(df).count() == n
    assert mixing.mix(df).count() == n
    assert jaccard.jaccard_components(df).count() == n
    assert media.digest_media(media.store_texts(df)).count() == n
    assert lines.report(df).count() == n
    assert packing.pack(df).select("doc_id").distinct().count() == df.select("doc_id").distinct().count()
