import base64
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("stellate.llm")
from stellate.llm import bpe, license_scan, order_minhash, packing, quality, secret_scan, sharding, simhash, suffix_dedup  # noqa: E402

from stellate.llm.tables import slices_of  # noqa: E402

from .conftest import prose, rows, same  # noqa: E402

vocab = pytest.importorskip("public_tokenizers")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- licenses ----

def license_brute(t):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    places = [(i, lab) for p, lab in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    base = sorted({lab for _, lab in places})
    found = {x for x in license_every_start(t or "", license_scan.TEMPLATES).split(",") if x}
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *found}))


def test_licenses_against_brute_force(docs, none):
    got = license_scan.scan(docs).drop("score").collect()
    same(got, [(i, *license_brute(t)) for i, t in rows()])
    assert license_scan.scan(none).count() == 0


def license_every_start(t, templates):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
    out = set()
    for lab, tt in templates.items():
        want, n = set(tt.split()), max(64, 2 * len(tt.split()))
        out |= {lab for s in range(len(words)) if len(want & set(words[s : s + n])) >= 0.9 * len(want) - 1e-9}
    return ",".join(sorted(out))


def test_licenses_at_every_start(spark):
    r = random.Random(8)
    long = " ".join(f"w{i}" for i in range(150))
    templates = license_scan.TEMPLATES | {"long": long}
    texts = []
    for i, t in enumerate([*templates.values()] * 12):
        words, gap = t.split(), r.choice([0.0, 0.4, 0.9, 1.3])
        spread = " ".join(f"{w} " + "zz " * int(r.random() + gap) for w in words)
        texts.append("zz " * r.randint(0, 140) + spread + " zz" * r.randint(0, 90))
    bsd = license_scan.TEMPLATES["bsd"].split()
    texts.append("zz " * 10 + " ".join(w + " zz zz" if i < 19 else w for i, w in enumerate(bsd)))
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = license_scan.matches(df, templates=templates).groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("l")).collect()
    got = {int(x["k"]): x["l"] for x in got}
    assert got == {i: w for i, t in enumerate(texts) if (w := license_every_start(t, templates))}
    assert any("long" in x for x in got.values()) and got[len(texts) - 1] == "bsd"


# ---- secrets ----

def jwt():
    enc = lambda v: base64.urlsafe_b64encode(json.dumps(v).encode()).decode().rstrip("=")
    return f"{enc({'alg': 'HS256'})}.{enc({'sub': '1'})}.c2lnbmF0dXJl"


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def pkcs1():
    r = random.Random(1)
    return der(0x30, der(2, b"\0") + b"".join(der(2, b"\1" + r.randbytes(30)) for _ in range(8)))


def test_structures_are_confirmed_and_lookalikes_not():
    key, bad = base64.b64encode(pkcs1()).decode(), base64.b64encode(pkcs1()[:-1] + b"\0\0").decode()
    kinds = lambda t: [k for _, _, k in secret_scan.spans(t)]
    assert kinds(f"see {key} end") == ["key"] and kinds(f"see {bad} end") == []
    assert kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{key}\n-----END RSA PRIVATE KEY-----") == ["key"]
    assert kinds(pkcs1().hex()) == ["hex", "key"]
    assert kinds(jwt()) == ["jwt"] and kinds("eyJhbGciOi.eyJzdWIi.c2ln") == []
    pkcs8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86")) + der(4, b"k" * 60))
    assert secret_scan.private_key(pkcs8) == "pkcs8" and secret_scan.private_key(der(0x30, der(2, b"\1") + der(4, b"k" * 32))) == "sec1"
    assert secret_scan.private_key(b"openssh-key-v1\0" + b"\0\0\0\4none" * 2 + b"\0\0\0\0" + b"\0\0\0\1") == "openssh"


def openssh():
    text = lambda b: len(b).to_bytes(4, "big") + b
    return b"openssh-key-v1\0" + text(b"none") * 2 + text(b"") + b"\0\0\0\1" + text(b"p" * 51) + text(random.Random(3).randbytes(136))


SEC1 = der(0x30, der(2, b"\1") + der(4, random.Random(4).randbytes(32)) + der(0xA0, der(6, b"\x2b\x81\x04\x00\x0a")))
WRAPS = {
    "plain": lambda x: "\n".join(x),
    "crlf": lambda x: "\r\n".join(x),
    "json": lambda x: r"\n".join(x),
    "json twice": lambda x: r"\\n".join(x).replace("/", r"\/"),
    "mail": lambda x: "\n".join("> " + y for y in x),
    "comment": lambda x: "\n".join("# " + y for y in x),
    "slashes": lambda x: "\n".join("// " + y for y in x),
    "added": lambda x: "\n".join("+" + y for y in x),
    "source": lambda x: " +\n    ".join(f'"{y}\\n"' for y in x),
    "joined": lambda x: '"' + '"  "'.join(x) + '"',
    "list": lambda x: ",\n".join(f"  '{y}'" for y in x),
}
CALLS = {"calls": lambda x: "\n".join(f'sb.append("{y}");' for y in x), "numbered": lambda x: "\n".join(f"line {i} {y}" for i, y in enumerate(x))}


@pytest.mark.parametrize("data", [pkcs1(), SEC1, openssh()], ids=["pkcs1", "sec1", "openssh"])
@pytest.mark.parametrize("wrap", [*WRAPS, *CALLS])
@pytest.mark.parametrize("armour", [True, False])
def test_wrapped_keys_are_found_whole(data, wrap, armour):
    one = base64.b64encode(data).decode()
    lines = [one[i : i + 64] for i in range(0, len(one), 64)]
    head, foot = "-----BEGIN X PRIVATE KEY-----", "-----END X PRIVATE KEY-----"
    body = (WRAPS | CALLS)[wrap]([head, *lines, foot] if armour else lines)
    text = f"Some words before:\n{body}\nand Words after"
    found = [(a, b) for a, b, k in secret_scan.spans(text) if k == "key"]
    first, last = (head, foot) if armour else (lines[0], lines[-1].replace("/", r"\/") if wrap == "json twice" else lines[-1])
    assert found == [(text.index(first), text.index(last) + len(last))]
    assert not any(x[:12] in secret_scan.redacted(text) for x in lines)
    broken = "".join(lines)[:-8]
    assert data == openssh() or not [k for *_, k in secret_scan.spans((WRAPS | CALLS)[wrap]([broken[i : i + 64] for i in range(0, len(broken), 64)])) if k == "key"]


@pytest.mark.parametrize("data", [pkcs1(), SEC1, openssh()], ids=["pkcs1", "sec1", "openssh"])
def test_hex_keys_are_found_in_any_case_and_wrap(data):
    up, mixed = data.hex().upper(), "".join(c.upper() if i % 3 else c for i, c in enumerate(data.hex()))
    pairs = [data.hex()[i : i + 2] for i in range(0, len(data) * 2, 2)]
    for body in ("\n".join(up[i : i + 60] for i in range(0, len(up), 60)), mixed, ":".join(pairs), ":\n    ".join(":".join(pairs[i : i + 15]) for i in range(0, len(pairs), 15)), ", ".join("0x" + p for p in pairs), "".join(r"\x" + p for p in pairs)):
        text = f"words {body} end"
        a = text.index(body) + (2 if body[:2] in ("0x", r"\x") else 0)
        assert [x[:2] for x in secret_scan.spans(text) if x[2] == "key"] == [(a, text.index(" end"))]


def secret_brute(t):
    t, out = t or "", []
    for m in re.finditer(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t):
        out += [(m.start(), 0, m.end(), "assign")] * (len(m[2]) >= 6)
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out)).encode()).hexdigest()


def test_secrets_against_brute_force(docs, none):
    got = secret_scan.scan(docs).select("doc_id", "base_sha256").collect()
    same(got, [(i, secret_brute(t)) for i, t in rows()])
    assert secret_scan.scan(none).count() == 0
    red = secret_scan.redact(docs)
    assert red.columns == docs.columns and red.count() == docs.count()
    assert not red.filter("text like '%hunter22%' or text like '%AKIA%'").count()
    assert secret_scan.redacted("token=abcdef token=token:abcdefg") == "[secret] token=token:abcdefg"


# ---- tokens ----

ODD = ["foo", " ", "  ", "\n", "'", "'re", "'ll", "<|endoftext|>", "é", "日本", "½", "3", "!!", "ß", "İ", "Σ", "\x1c", "\x85", " ", "don't", " the of", "x" * 30]


def test_encoders_agree_with_the_library_on_odd_texts():
    r = random.Random(2)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 80))) for _ in range(200)] + [prose(7, 3000), ""]
    e7, e5 = bpe.ChunkEncoder(vocab.path("byte_bpe_50k.json")), bpe.WordEncoder(vocab.path("word_bpe_49k.json"))
    for t in texts:
        want = e7.tok.encode(t, add_special_tokens=False).ids
        assert e7.encode(t) == bpe.packed(want) and e7.decode(bpe.packed(want)) == e7.tok.decode(want, skip_special_tokens=False)
        assert e5.encode(t) == bpe.packed(e5.tok.encode(t, add_special_tokens=False).ids)


def test_seams_are_repaired_at_any_cut():
    r = random.Random(5)
    e = bpe.ChunkEncoder(vocab.path("byte_bpe_50k.json"))

    def cut(t):
        out, i = [], 0
        while i < len(t):
            n = r.randint(1, 12)
            out.append(t[i : i + n])
            i += n
        return out

    e.cut = cut
    for _ in range(120):
        t = "".join(r.choice(ODD) for _ in range(r.randint(1, 40)))
        assert e.encode(t) == bpe.packed(e.tok.encode(t, add_special_tokens=False).ids)
    assert e.repaired


def test_chunks_are_shared_by_copies():
    e, passage = bpe.ChunkEncoder(vocab.path("byte_bpe_50k.json")), prose(8, 900)
    a, b = set(e.cut(prose(9, 10) + " " + passage)), set(e.cut(prose(10, 37) + " " + passage))
    assert len(a & b) > 3


def test_round_trip_rows(docs, none):
    path = vocab.path("byte_bpe_50k.json")
    tok = bpe.load(path)
    want = []
    for i, t in rows():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(bpe.packed(ids)).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same(bpe.round_trip(docs, path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect(), want)
    assert bpe.round_trip(none, path).count() == 0


def test_memories_stay_small_and_whole(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 40)
    monkeypatch.setattr(bpe, "CHUNKS", 5)
    e7, e5 = bpe.ChunkEncoder(vocab.path("byte_bpe_50k.json")), bpe.WordEncoder(vocab.path("word_bpe_49k.json"))
    for i in range(12):
        texts = [prose(i, 300), prose(i // 2, 300)]
        for e in (e7, e5):
            assert e.encode_all(texts) == [bpe.packed(e.tok.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(e7.chunks.keys) <= 5 and len(e7.words.keys) <= 40 and len(e5.words.keys) <= 40 and len(e5.cores.keys) <= 40


def test_encoders_on_odd_texts():
    rng = random.Random(5)
    marks = ["a", "Été", "the", "don't", "9", "x!?", "漢字", "ß", "İ", "😀", "é", "<|endoftext|>", "--", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u200b", "\u3000", "\ufeff", "\x00"]
    texts = ["", " ", "\x1c", *("".join(rng.choices(marks, k=rng.randrange(1, 400))) for _ in range(150)), *(" ".join(rng.choices(marks[:13], k=rng.randrange(1, 400))) for _ in range(150))]
    for e in (bpe.ChunkEncoder(vocab.path("byte_bpe_50k.json"), 4), bpe.WordEncoder(vocab.path("word_bpe_49k.json"))):
        want = [bpe.packed(e.tok.encode(t, add_special_tokens=False).ids) for t in texts]
        assert e.encode_all(texts) == want and e.encode_all(texts[::-1]) == want[::-1]


def test_slices_by_rows_and_bytes():
    import pyarrow as pa

    texts = ["x" * 10, None, "", "y" * 100, "é" * 30, "z"]
    b = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["doc_id", "text"])
    got = [s.column(0).to_pylist() for s in slices_of([b, b.slice(6)], 1, size=61)]
    assert got == [[0, 1, 2], [3], [4, 5]]
    assert [s.num_rows for s in slices_of([b], 1, rows=4, size=1 << 20)] == [4, 2]


# ---- packing ----

def test_packing_covers_every_id_once(docs, none):
    path = vocab.path("word_bpe_49k.json")
    for size in (2048, 64):
        got = packing.pack(docs, path, size).collect()
        by_seq = {}
        for r in got:
            by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert sorted(by_seq) == list(range(len(by_seq)))
        for s in by_seq.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at <= size
        tok = bpe.load(path)
        want = []
        for i, t in rows():
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
            want += [(i, a, min(size, len(ids) - a), zlib.crc32(bpe.packed(ids[a : a + size])), len(ids)) for a in range(0, len(ids), size)]
        same([tuple(r)[:5] for r in got], want)
    assert packing.pack(none, path).count() == 0


def test_plans_are_dense_and_bounded():
    r = random.Random(3)
    h = {n: r.randint(1, 1000) * 1000 for n in range(1, 2049)}
    p = packing.plan(h)
    used = {}
    for content, count in p:
        assert sum(content) <= 2048
        for n in content:
            used[n] = used.get(n, 0) + count
    assert used == h and len(p) <= 2 * 2048
    assert sum(n * c for n, c in h.items()) / (2048 * sum(c for _, c in p)) > 0.98


# ---- near duplicates ----

def fingerprint_brute(t):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_brute(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    fs = sorted(set(fps))
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fs}


def test_simhash_against_brute_force(docs, none):
    fp = [(i, fingerprint_brute(t)) for i, t in rows()]
    root = components_brute([f for _, f in fp])
    least = {}
    for i, f in fp:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    got = [(r[0], r[1] & (1 << 64) - 1, r[2]) for r in simhash.near_duplicates(docs).collect()]
    same(got, [(i, f, least.get(root[f])) for i, f in fp])
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root.values()))


def test_golay_keys_meet_within_two_bits():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 62, 2000).astype(np.int64)
    y = x.copy()
    for i in range(len(y)):
        for b in r.choice(64, r.integers(0, 3), replace=False):
            y[i : i + 1].view(np.uint64)[0] ^= np.uint64(1 << int(b))
    keys = []
    for v in (x, y):
        k, row = simhash.fuzzy_keys(v)
        keys.append([set() for _ in v])
        for a, i in zip(k.tolist(), row.tolist(), strict=True):
            keys[-1][i].add(a)
    assert all(a & b for a, b in zip(*keys, strict=True))
    assert all(np.bitwise_count(np.uint64(c)) <= 3 for c in simhash._ERROR)


@pytest.mark.parametrize(("small", "hot"), [(24, 20000), (2, 20000), (2, 3)])
def test_links_of_dense_groups(spark, monkeypatch, small, hot):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "HOT", hot)
    r = random.Random(4)
    fps, f = set(), 12345
    for _ in range(150):
        f ^= 1 << r.randrange(63)
        if r.random() < 0.3:
            f ^= 7 << r.randrange(60)
        fps.add(f)
    got = simhash.components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")), "a", "b").collect()
    want = {a: b for a, b in components_brute(fps).items() if a != b}
    assert {r["node"]: r["root"] for r in got} == want


# ---- suffixes ----

def suffix_brute(texts, size=200):
    from collections import Counter

    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize(("size", "hot"), [(200, 1_000_000), (200, 300), (16, 1_000_000), (32, 50), (300, 500), (1000, 1_000_000), (1000, 0)])
def test_suffixes_against_brute_force(spark, docs, none, monkeypatch, size, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    if size >= 200:
        want = suffix_brute([(t or "").encode() for _, t in rows()], size)
        got = [(*tuple(r)[:4], bytes(r["kept"])) for r in suffix_dedup.remove(docs, size).collect()]
        same(got, [(i, *w) for (i, _), w in zip(rows(), want, strict=True)])
    if (size, hot) == (200, 1_000_000):
        assert suffix_dedup.remove(none).count() == 0
    r = random.Random(6)
    base = ["".join(r.choice("abcdé ") for _ in range(4 * size + 100)) for _ in range(4)]
    texts = []
    for _ in range(60):
        b, a = r.choice(base), r.randint(0, 3 * size)
        x = b[a : a + size + r.choice([-10, -1, 0, 1, 50, 100])]
        if r.random() < 0.4:  # differs at one place
            i = r.randrange(len(x))
            x = x[:i] + "#" + x[i + 1 :]
        texts.append(prose(r.randint(0, 9999), 3) + x + prose(r.randint(0, 9999), 3))
    got = suffix_dedup.remove(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), size).collect()
    same([(*tuple(g)[:4], bytes(g["kept"])) for g in got], [(i, *w) for i, w in enumerate(suffix_brute([t.encode() for t in texts], size))])


def test_suffix_thresholds_have_a_range(docs):
    for size in (0, suffix_dedup.MOST + 1):
        with pytest.raises(ValueError, match="threshold"):
            suffix_dedup.remove(docs, size)


def test_digit_passes_end_on_equal_bytes():
    from collections import Counter

    r = random.Random(1)
    for depth in (1, 3, 8, 16, 20, 200):
        t = bytes(r.choice(b"ab") for _ in range(1500)) + b"abcabcab" * 100
        data, n = np.frombuffer(t, np.uint8), len(t) - depth + 1
        group = np.array([r.randrange(2) for _ in range(n)])
        many = Counter((int(group[i]), t[i : i + depth]) for i in range(n))
        got = suffix_dedup.equal_at(data, np.arange(n), group, depth)
        assert sorted(got.tolist()) == [i for i in range(n) if many[int(group[i]), t[i : i + depth]] > 1]


def test_deduplicated_keeps_rows_and_columns(docs):
    out = suffix_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter("text is null").count() == docs.filter("text is null").count()


# ---- order minhash ----

M64, M32 = (1 << 64) - 1, (1 << 32) - 1


def mix_brute(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def order_minhash_brute(text, s):
    """64 numbers of a text: plain dictionaries, sorting and whole numbers; only the drawn constants are the sketcher's."""
    import xxhash

    steps, words = [int(x) for x in s.steps], []
    for w in text.split():
        if len(w) <= 16:
            words.append(xxhash.xxh64_intdigest(w.encode(), order_minhash.SEED))
            continue
        for i in range(len(w) - 15):
            h = 0
            for c in w[i : i + 16]:
                h = (h * 0x100000001B3 + mix_brute((ord(c) + steps[0]) & M64)) & M64
            words.append(mix_brute(h))
    if not words:
        return [0] * 64
    k, seen, kmers = min(3, len(words)), {}, []
    for i in range(len(words) - k + 1):
        g = 0
        for j in range(k):
            g = mix_brute((g + words[i + j] * steps[j]) & M64)
        seen[g] = seen.get(g, -1) + 1
        kmers.append(mix_brute((g + seen[g] * 0x9E3779B97F4A7C15) & M64))
    out = []
    for a, b in zip(s.times, s.plus, strict=True):
        least = sorted(range(len(kmers)), key=lambda i: (((kmers[i] >> 32) * int(a) + int(b)) & M32, i))[:2]
        t = 0
        for j, i in enumerate(sorted(least)):
            t = mix_brute((t + kmers[i] * steps[j]) & M64)
        out.append(t >> 48)
    return out


def test_likeness_survives_repeats():
    s = order_minhash.Sketcher()
    like = lambda x, y: order_minhash.likeness(s.sketch(x), s.sketch(y))
    words = [f"w{i}" for i in range(300)]
    a = " ".join(words)
    assert like(a, f"{a} {' '.join(words[-3:])}") > 0.8 and like(a, f"{a} new words") > 0.8
    twice = f"{a} {a}"
    assert like(twice, f"{twice} new words") > 0.8
    run = "".join(chr(0x4E00 + i * 37 % 900) for i in range(400))
    assert like(run, "x" + run) > 0.8 and like(run + " tail", run[:200] + "y" + run[200:] + " tail") > 0.6
    random.Random(1).shuffle(words)
    assert like(a, a) == 1 and like(a, " ".join(words)) < 0.1 and like("", " ") == 1
    assert like(a, " ".join(words[:150]) + " " + a) < like(a, a + " tail")


@pytest.mark.parametrize("parts", ["4", "1", "13"])
def test_order_fingerprints_against_brute_force(spark, docs, none, parts):
    s = order_minhash.Sketcher()
    some = sorted({(i, t) for i, t in rows() if i is not None and i != 10}, key=lambda x: -x[0])
    some += [(-1, " ".join(["the cat sat"] * 20)), (-2, "a b c " * 9 + "x" * 40 + " a b c")]
    want = []
    shown = lambda v: "".join(f"{x:04x}" for x in v)
    alike = lambda v, w: sum(x == y for x, y in zip(v, w, strict=True)) / 64
    for j, (i, t) in enumerate(some):
        t, nxt = t or "", some[(j + 1) % len(some)][1] or ""
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        x, y, z = (order_minhash_brute(v, s) for v in (t, e, nxt))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), shown(x), shown(y), alike(x, y), alike(x, z)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = spark.createDataFrame([(i, t, "c", 1) for i, t in some], "doc_id long, text string, body string, part int").repartition(4)
        same(order_minhash.edited_neighbours(df).collect(), want)
        by_name = order_minhash.edited_neighbours(df.select(F.format_string("%05d", F.col("doc_id") + 100).alias("doc_id"), "text")).collect()
        same([tuple(r)[1:] for r in by_name], [w[1:] for w in want])
        assert order_minhash.edited_neighbours(docs).count() == docs.count() and order_minhash.edited_neighbours(none).count() == 0
        alone = order_minhash.edited_neighbours(df.limit(0).unionByName(df.filter("doc_id = -1"))).collect()
        assert len(alone) == 1 and alone[0]["near_next"] == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = {r["doc_id"]: r["fingerprint"] for r in order_minhash.fingerprints(df).collect()}
    assert got == {w[0]: w[3] for w in want}


# ---- quality ----

def test_quality_separates_and_survives_odd_rows(spark, docs, none):
    junk = lambda i: " ".join(w + "&&&" for w in prose(i, 60).split())
    n = 300
    texts = [(100 + i, junk(i) if i % 3 == 0 else prose(i, 60)) for i in range(n)]
    marks = spark.createDataFrame([(100 + i, int(i % 3 != 0)) for i in range(n)] + [(None, 1), (7, None), (100, 0)], "doc_id long, quality int")
    every = spark.createDataFrame(texts, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = {r["doc_id"]: r for r in quality.classify(every, marks).collect()}
    assert all(got[100 + i]["predicted"] == int(i % 3 != 0) for i in range(n))
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got if i is not None)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert quality.classify(none, marks).count() == 0
    assert quality.classify(docs, marks.limit(0)).filter("score <> 0.5").count() == 0
    kept = quality.accepted(every, marks)
    assert kept.columns == every.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}
    for one in (marks.filter("quality = 0"), marks.limit(0)):
        assert quality.accepted(every, one).count() == every.count()
    assert quality.accepted(none, marks).count() == 0


def test_quality_scores_against_plain_discriminant(spark):
    """Class Gaussians from all training rows at once; determinants and solutions in place of Cholesky factors."""
    texts = [(i, prose(i, 20 + i % 50) if i % 3 else " ".join(w + "!?" * (i % 4) for w in prose(i, 30).split()).upper()) for i in range(400)]
    marks = {i: int(i % 3 != 0 or i % 7 == 0) for i in range(0, 400)}
    x = np.array([quality.statistics(t) for _, t in texts])
    train = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in texts])
    y = np.array([marks[i] for i, _ in texts])
    own = {c: x[train & (y == c)] for c in (0, 1)}
    cov = {c: np.cov(v.T, bias=True) for c, v in own.items()}
    n = {c: len(v) for c, v in own.items()}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    logs = {}
    for c in (0, 1):
        s = (1 - quality.TO_POOLED) * cov[c] + quality.TO_POOLED * pooled
        s = (1 - quality.TO_IDENTITY) * s + (quality.TO_IDENTITY * np.trace(pooled) / x.shape[1] + 1e-6) * np.eye(x.shape[1])
        r = x - own[c].mean(0)
        logs[c] = np.log(n[c] / (n[0] + n[1])) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (r * np.linalg.solve(s, r.T).T).sum(1)
    delta = logs[1] - logs[0]
    cuts = np.sinh(np.arange(np.floor(np.arcsinh(delta[train].min()) * quality.BINS), np.floor(np.arcsinh(delta[train].max()) * quality.BINS) + 2) / quality.BINS)
    right = np.array([(delta[train & (y == 1)] >= c).mean() + (delta[train & (y == 0)] < c).mean() for c in cuts])
    best = np.flatnonzero(np.isclose(right, right.max(), atol=1e-12))
    shift = np.sinh((np.arcsinh(cuts[best[0]]) + np.arcsinh(cuts[best[-1]])) / 2)
    want = 1 / (1 + np.exp(-(delta - shift + np.log(quality.CUT / (1 - quality.CUT)))))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in quality.classify(docs, spark.createDataFrame(list(marks.items()), "doc_id long, quality int")).collect()}
    assert [got[i]["score"] for i in range(400)] == pytest.approx(want.tolist(), abs=1e-9)
    assert [got[i]["predicted"] for i in range(400)] == (want >= quality.CUT).astype(int).tolist()


# ---- sharding ----

def test_sharding_law(docs, none):
    tree = sharding.even_tree(8)
    got = sharding.shard(docs, tree, sharding.grown_tree(tree, 8)).collect()
    same([(r["doc_id"], r["size"], r["text_crc32"]) for r in got], [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows()])
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(none, tree).count() == 0


def test_weights_confine_movement(spark):
    leaf, node = sharding.Leaf, sharding.Node
    make = lambda w: node("root", (node("a", (leaf("a1", 0), leaf("a2", 1, w))), node("b", (leaf("b1", 2), leaf("b2", 3, 2.0)))))
    k = F.col("id").cast("string")
    d = spark.range(4000).select(sharding.descend(k, make(1.0)).alias("old"), sharding.descend(k, make(3.0)).alias("new"))
    n = {(r["old"], r["new"]): r["count"] for r in d.groupBy("old", "new").count().collect()}
    assert all(a == b or b in (0, 1) for a, b in n) and not n.get((2, 3)) and not n.get((1, 0))
    old = {s: sum(c for (a, _), c in n.items() if a == s) for s in range(4)}
    assert old[3] == pytest.approx(4000 * 2 / 5, rel=0.1)
