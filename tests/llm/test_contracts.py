"""The operators' queries on small tables with every awkward row, against plain models of the contracts."""

import base64
import gzip
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from riftline.llm import decontaminate, embeddings, langid, licenses, packing, pii, sharding, simhash, substrings, warc
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns that operators use inside; they must not get in the way.
CLASHES = ("_rk", "key", "h", "n", "print", "bucket", "node", "shard", "size", "term", "start", "lang_pred", "score", "length", "content")


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "ter", "on", "du", "sé", "Vi"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def awkward():
    long = words(30_000, 1)
    base = words(120, 2)
    texts = [None, "", " \n\t", "a", "Ab cD", base, base, base + " x", base.replace(" ", "\n", 3), long, long, words(60, 3) + " a.b@c-d.example.org 1.2.3.4 +1 (555) 123-4567 4111 1111 1111 1111", "12345 !!", "É" * 50]
    rows = [(k, t, "en" if k % 2 else None, "s", len(t or "")) for k, t in enumerate(texts)]
    return [*rows, (5, base, "en", "s", 1), (None, base, None, None, None), (None, None, None, None, None), (7, "other", "fr", "s", 5)]


def frame(spark, rows, schema=DOCS):
    made = spark.createDataFrame(rows, schema)
    return made.withColumns({c: F.lit("clash") for c in CLASHES if c not in made.columns})


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, awkward()).cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, words(120, 2)[:200]), (2, "cd"), (3, None), (4, ""), (5, words(40, 9)), (6, "cd")], "item_id long, text string")


QUERIES = [
    ("op1", lambda d, i: sharding.query(d)), ("op3", lambda d, i: simhash.query(d)), ("op4", lambda d, i: pii.query(d)), ("op5", lambda d, i: decontaminate.query(d, i)), ("op6", lambda d, i: licenses.query(d)),
    ("op7", lambda d, i: langid.query(d)), ("op9", lambda d, i: packing.query(d)), ("op10", lambda d, i: substrings.query(d)),
]


@pytest.mark.parametrize(("name", "run"), QUERIES, ids=[n for n, _ in QUERIES])
def test_empty_tables(spark, items, name, run):
    assert run(frame(spark, []), items).count() == 0


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_sharding(docs):
    keys = {r.doc_id: r.h % 2**64 for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    rows = sharding.query(docs).collect()
    assert len(rows) == len(awkward())
    for r in rows:
        assert r.shard == jump(keys[r.doc_id], 24)
        assert r.grown_shard in (r.shard, 24)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    wanted = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in awkward())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == wanted


def test_archives(spark, tmp_path):
    rows = [(1, "http://a/é b\r\n", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 3_000_000), (6, "u", "x"), (6, "u", "x"), (None, "u", "x"), (None, "u", "only"), (8, "u", "WARC/1.1\r\n\r\n")]
    pages = frame(spark, rows, T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())]))
    found = warc.query(pages).collect()
    payload = lambda h: (h or "").encode()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[payload(h)] = min(i, first.get(payload(h), i))
    seen, wanted = set(), Counter()
    for i, _, h in rows:
        p = payload(h)
        response = p not in first or (first[p] == i and i not in seen)
        seen |= {i} if first.get(p) == i else set()
        wanted[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if response else "revisit", None if response else first[p]] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == wanted
    assert all(r.intact for r in found)
    manifest = warc.write_archives(pages, "page_id", "url", "html", str(tmp_path / "w"), roll_bytes=1).collect()
    assert sum(m.records for m in manifest) == len(manifest) == len(rows)
    assert sorted(m.file for m in manifest) == sorted(p.name for p in (tmp_path / "w").glob("*.warc.gz"))
    assert warc.query(pages.where("false")).count() == 0


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not w:
        return 0
    s = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    votes = Counter(b for x in s for h in [xxh64_intdigest(x, 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(s))


def groups(ids, prints, close):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if close(prints[a], prints[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min((x for x in (i, least.get(root(k))) if x is not None), default=None)
    return [least[root(k)] for k in range(len(ids))]


def test_simhash(docs):
    rows = awkward()
    prints = [fingerprint(t) for _, t, *_ in rows]
    names = groups([r[0] for r in rows], prints, lambda a, b: bin(a ^ b).count("1") <= 4)
    wanted = Counter((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, names, strict=True))
    assert Counter(map(tuple, simhash.query(docs).collect())) == wanted


def test_golay_keys_share_within_four_bits():
    r = np.random.default_rng(0)
    a = r.integers(-(2**63), 2**63 - 1, 4000, dtype=np.int64)
    b = a.copy()
    for k in range(len(b)):
        for bit in r.choice(64, r.integers(1, 5), replace=False):
            b[k] ^= np.uint64(1 << int(bit)).view(np.int64)
    keys = []
    for x in (a, b):
        own = [set() for _ in x]
        for key, row in zip(*(y.tolist() for y in simhash.fuzzy_keys(x)), strict=True):
            own[row].add(key)
        keys.append(own)
    assert all(x & y for x, y in zip(*keys, strict=True))


def test_simhash_dense_group(spark):
    """Hundreds of fingerprints a bit or two apart: one group, though most pairs are further apart."""
    r = np.random.default_rng(1)
    prints = {0}
    while len(prints) < 300:
        p = r.choice(sorted(prints))
        prints.add(int(p) ^ 1 << int(r.integers(0, 60)))
    found = simhash.link(spark.createDataFrame([(p,) for p in prints], "print long")).collect()
    assert len(found) == len(prints)
    assert len({x.root for x in found}) == 1


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (14 <= len(d) <= 19 and pii.luhn(d))) or (k == 3 and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_patterns():
    r = random.Random(1)
    for n in range(20_000):
        t = "".join(r.choice("ab1234567890..--  @@+()"[3 * (n % 2) :]) for _ in range(r.randint(0, 45)))
        assert pii.base_spans(t) == base_spans(t)


def test_personal_query(docs):
    """These texts have too few identifiers for a context to be confident: all spans are base spans."""
    rows = Counter()
    for i, t, *_ in awkward():
        b = base_spans(t or "")
        spans = ",".join(f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in b)
        rows[i, *(sum(s[1] == k for s in b) for k in range(4)), hashlib.sha256(spans.encode()).hexdigest(), spans] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in pii.query(docs).collect()) == rows


def test_personal_contexts_discover(spark):
    known = [(k, f"{words(30, k)} hotline zentral +1 (555) 123-4{k:03d} {words(20, 500 + k)}") for k in range(8)]
    unseen = [(100, f"{words(30, 900)} hotline zentral 555-987-6543 {words(20, 901)}"), (101, f"{words(30, 902)} order 555-987-6599 {words(20, 903)}")]
    found = {r.doc_id: r.spans for r in pii.query(spark.createDataFrame(known + unseen, "doc_id long, text string")).collect()}
    at = unseen[0][1].index("555-987")
    assert found[100] == f"phone:{at}:{at + 12}"
    assert found[101] == ""


def test_redaction(spark):
    d = spark.createDataFrame([(1, "a x@y.zz b 1.2.3.4", "k"), (2, None, "k"), (3, "plain", "k")], "doc_id long, text string, start string")
    assert {r.doc_id: r.text for r in pii.redact(d, "doc_id", "text").collect()} == {1: "a [EMAIL] b [IP]", 2: None, 3: "plain"}


def test_decontamination(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    wins = [(r.item_id, w[k : k + 10]) for r in items.collect() for w in [split(r.text)] if w for k in range(max(1, len(w) - 9))]
    wanted = Counter()
    for i, t, *_ in awkward():
        w = split(t)
        starts = {}
        for k, x in enumerate(w):
            starts.setdefault(x, []).append(k)
        hit, named = set(), set()
        for item, win in wins:
            for k in starts.get(win[0], []):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    named.add(str(item))
        wanted[i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)] += 1
    assert Counter(map(tuple, decontaminate.query(docs, items).collect())) == wanted


def test_decontamination_and_licences_as_sql(spark):
    duck = connect(SF)
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    same(decontaminate.query(read("documents"), read("benchmark")), decontaminate.ORACLE_SQL, duck)
    same(licenses.query(read("documents")), licenses.ORACLE_SQL, duck)


def test_proximity(spark):
    """The two rarest terms are the ends of the item: as far apart as there, one word more, too far, alone."""
    inner = [f"w{k}" for k in range(8)]
    item = ["alpha", *inner, "omega"]
    texts = [item, [*item[:5], "inserted", *item[5:]], [*item[:5], "two", "more", *item[5:]], inner * 9, ["omega", *inner, "alpha"]]
    docs = spark.createDataFrame([(k + 1, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    found = decontaminate.proximity_matches(docs, items, key="doc_id", text="text", item="item_id", item_text="text", slop=1).collect()
    assert {(r["_rk"]["k"], r["gap"]) for r in found} == {(1, 0), (2, 1)}


def test_licence_spellings(spark):
    mit = next(t for n, k, t in licenses.KNOWN if n == "MIT" and k == "text")
    variant = "Copyright (c) 2020 Some One\n" + mit.upper().replace("\n", "\n\n").replace("COPYRIGHT HOLDERS", "copyright owners").replace(",", " ")
    d = spark.createDataFrame([(1, variant), (2, mit + " and more"), (3, "x\nreleased under the mit licence!")], "doc_id long, text string")
    found = {r.doc_id: (r.licence_id, r.notices) for r in licenses.query(d).collect()}
    assert found == {1: ("MIT", ""), 2: (None, ""), 3: (None, "MIT")}


def test_languages(spark, docs):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.query(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)
    assert all(0 <= r.score <= 1 for r in found)
    small = langid.query(docs).collect()
    assert len(small) == len(awkward())
    texts = {i: t for i, t, *_ in awkward() if i not in (None, 5, 7)}
    for r in small:
        if r.doc_id in texts:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))


def test_labels_with_next_to_no_text_win_nothing(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    stray = spark.createDataFrame([(10**9, "", "aa"), (10**9 + 1, "ok", "bb"), (10**9 + 2, "123", "cc")], d.schema)
    texts = [r.text for r in d.where("length(text) > 50").collect()]
    without, with_ = (langid.fit(x, "doc_id", "text", "lang").predict(texts) for x in (d, d.unionByName(stray)))
    assert with_.lang_pred.tolist() == without.lang_pred.tolist()
    assert np.allclose(with_.bits, without.bits)


def test_cost_is_a_code_length():
    """However short a sample is, the texts of n symbols share a probability of one at most."""
    for sample in ([], [2], [2, 3], [2, 3, 4, 2]):
        model = langid.Model(["a"], [langid.automaton(np.array(sample, dtype=np.int64), 5)], [len(sample)], np.zeros(1, dtype=np.uint8))
        texts = np.array(list(itertools.product((0, 2, 3, 4), repeat=5))).T
        bits = model.bits(texts, np.full(texts.shape[1], 5), model.tables[0], len(sample))
        assert (2.0**-bits).sum() <= 1
        assert bits.min() > 0


def test_automaton_parses_like_substring_search():
    text = words(300, 5).lower()
    seen = sorted(set(text))
    symbol = {c: k for k, c in enumerate(seen)}
    table = langid.automaton(np.array([symbol[c] for c in text]), len(seen))
    probe = words(60, 6).lower() + text[40:90]
    state, phrases = 0, 0
    for c in probe:
        if c not in symbol:
            continue
        nxt = table[state, symbol[c]]
        if not nxt:
            phrases += 1
            nxt = table[0, symbol[c]]
        state = nxt
    k, wanted = 0, 0
    probe = "".join(c for c in probe if c in symbol)
    while k < len(probe):
        n = 1
        while k + n < len(probe) and probe[k : k + n + 1] in text:
            n += 1
        k, wanted = k + n, wanted + 1
    assert phrases + 1 == wanted


def test_vectors(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(300, 20))
    near = v[:120] + r.normal(size=(120, 20)) * r.uniform(0, 0.4, (120, 1))
    rows = [(k, x.tolist()) for k, x in enumerate(np.concatenate([v, near, v[:5], 3 * v[5:10], v[:1]]))]
    rows[-1] = (None, rows[-1][1])
    odd = [(900, None), (901, [0.0] * 20), (902, [float("nan")] * 20), (903, [None] * 20), (904, []), (905, [1.0]), (906, [float("inf")] * 20)]
    found = {x.vec_id: x for x in embeddings.query(frame(spark, rows + odd, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))]))).collect()}
    m = np.array([x for _, x in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    close = m @ m.T >= 0.95
    true, got = close.sum(axis=1) - 1, np.array([found[k].n_links for k, _ in rows])
    names = groups([k for k, _ in rows], list(range(len(rows))), lambda a, b: close[a, b])
    assert np.mean([found[k].component_id == c for (k, _), c in zip(rows, names, strict=True)]) >= 0.95
    assert all(x.kept == (x.vec_id == x.component_id) for x in found.values() if x.vec_id is not None)
    assert (got <= true).all()
    assert got.sum() >= 0.95 * true.sum()
    assert all(found[k].n_links == 0 and found[k].kept for k in range(900, 907))
    assert (found[None].n_links, found[None].component_id, found[None].kept) == (found[0].n_links, found[0].component_id, False)
    assert embeddings.query(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_vectors_in_hot_buckets_only(spark):
    """Batches without a small comparable bucket: one large bucket, lookers only, stored rows only."""
    r = np.random.default_rng(5)
    v = r.normal(size=20) + r.normal(size=(300, 20)) * 0.01
    m = v / np.linalg.norm(v, axis=1, keepdims=True)
    looks = np.arange(300) % 2 == 1
    a, b = embeddings._close(v, looks, np.array([0, 300]), 0.95)
    assert len(a) == len(set(zip(a.tolist(), b.tolist(), strict=True))) == (m[looks] @ m[~looks].T >= 0.95).sum()
    for one in (True, False):
        assert not len(embeddings._close(v, np.full(300, one), np.array([0, 100, 300]), 0.95)[0])
    found = embeddings.query(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()
    true = (m @ m.T >= 0.95).sum(axis=1) - 1
    assert {x.vec_id: x.n_links for x in found} == dict(enumerate(true.tolist()))
    assert {x.component_id for x in found} == {0}


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = Counter()
    for i, t, *_ in awkward():
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            wanted[i, piece, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    rows = packing.query(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(sequences) <= -(-sum(r.length for r in rows) // 4096) + 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_whole_and_tight(seed):
    r = random.Random(seed)
    counts = Counter(r.randint(1, 200) for _ in range(r.randint(1, 400)))
    plan = packing.Plan(dict(counts), 200)
    placed = Counter()
    for lengths, n in plan.patterns:
        assert sum(lengths) <= 200
        for x in lengths:
            placed[x] += n
    assert placed == counts
    assert sum(n for _, n in plan.patterns) <= 1.05 * sum(k * v for k, v in counts.items()) / 200 + 2 or max(counts) > 100


@pytest.mark.parametrize("text", ["Ça va's don't 3.14 İĞ", "Σας ΟΔΥΣΣΕΥΣ", "a <|endoftext|> b", "x\x85y\x1cz\xa0w", "é 漢字 🙂", "", "don''s ''t 'll"])
def test_word_memo_gives_the_files_ids(text):
    import public_tokenizers

    t = packing.worker_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert list(t.encode([text])) == [np.array(t.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()]


def test_passages(spark):
    rows, r = [], random.Random(4)
    for k in range(0, 60, 2):
        passage = words(r.randint(51, 80), 1000 + k)
        rows += [(k + j, f"{words(r.randint(0, 60), 3000 + k + j)} {passage} {words(r.randint(0, 60), 5000 + k + j)}") for j in (0, 1)]
    clean = [(1000 + k, words(200, 7000 + k)) for k in range(60)]
    found = substrings.query(frame(spark, rows + clean + [(None, None), (None, ""), (2000, words(3, 1))], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))).collect()
    got = {x.doc_id for x in found}
    assert set(range(60)) <= got
    assert not got & set(range(1000, 1060))
    assert {x.doc_id for x in found if x.removed} == set(range(1, 60, 2))


def test_whole_documents_and_periodic_text(spark):
    """Copies of any length whole, from the first character to the last; runs without a local minimum; no stock phrases."""
    twelve, lines, spam = words(12, 40), "\n".join(words(10, 50 + k) for k in range(30)), "buy now at shop " * 30
    texts = [twelve, twelve, words(19, 41), words(19, 41), lines, lines, f"{words(40, 42)} {spam}{words(40, 43)}", f"{words(40, 44)} {spam}{words(40, 45)}"]
    texts += [f"{words(60, 46 + k)}\nAll rights reserved by us.\n{words(60, 146 + k)}" for k in range(4)]
    found = substrings.query(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(x.doc_id, x.kept_doc_id, x.removed, x.start, x.end) for x in found if x.doc_id < 6} == {(k, k - k % 2, k % 2 == 1, 0, len(texts[k])) for k in range(6)}
    assert all(sum(x.words for x in found if x.doc_id == k) > 90 for k in (6, 7))
    assert not {x.doc_id for x in found if x.doc_id > 7}


def test_spans_of_planted_passages(spark):
    """The longest common runs of words, no more and no less: the passages, and words beside them that happen to agree."""
    rows, wanted, beside = [], {}, 0
    for k in range(20):
        passage = words(70, 9000 + k).split()
        sides = [(words(30 + 7 * k % 40, 9100 + 2 * k + j).split(), words(50, 9200 + 2 * k + j).split()) for j in (0, 1)]
        left = next(n for n in range(99) if sides[0][0][-n - 1].lower() != sides[1][0][-n - 1].lower())
        right = next(n for n in range(99) if sides[0][1][n].lower() != sides[1][1][n].lower())
        beside += left + right
        for j, (before, after) in enumerate(sides):
            text = " ".join(before + passage + after)
            rows.append((2 * k + j, text))
            start = len(" ".join(before[: len(before) - left])) + 1
            wanted[2 * k + j] = (start, start + len(" ".join(before[len(before) - left :] + passage + after[:right])))
    assert beside <= 4
    found = substrings.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.start, x.end) for x in found) == sorted((d, *span) for d, span in wanted.items())


def test_record_ids_are_unique(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x"), (1, "u", "y"), (1, "u", "x"), (2, "u", "y")], "page_id long, url string, html string")
    warc.write_archives(pages, "page_id", "url", "html", str(tmp_path / "w"))
    heads = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.warc.gz")))
    ids, refers = (re.findall(name + rb": (<[^>]*>)", heads) for name in (rb"WARC-Record-ID", rb"WARC-Refers-To"))
    assert len(ids) == len(set(ids)) == 4
    assert len(refers) == 2
    assert set(refers) < set(ids)


@pytest.mark.parametrize("at", ["[at]", "[AT]", "(at)", "(AT)"])
def test_spelt_at(at):
    assert list(pii._unseen(f"write to joe {at} x.example.org now", []))


def test_similar_lines_are_found_exactly(spark):
    r = random.Random(9)
    rows = []
    for b in range(12):
        base = words(60, 100 + b).split()
        for v in range(5):
            w = list(base)
            for _ in range(v % 4):
                w[r.choice([0, 1, 58, 59, 30])] = f"new{b}{v}"
            rows.append((len(rows), " ".join(w)))
    shingles = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for _, t in rows for w in [t.lower().split()]]
    names = groups(list(range(len(rows))), shingles, lambda a, b: len(a & b) / len(a | b) >= 0.8)
    sizes = Counter(names)
    wanted = {k: c for k, c in enumerate(names) if sizes[c] > 1}
    found = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").where("line").collect()
    assert {(x["_rk"]["k"], x["keeper"]["_rk"]["k"]) for x in found} == set(wanted.items())
