"""Secrets, contamination, quality rules and shards against brute force."""

import base64
import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from routeforge.llm import contamination, decision_list, doc_stats, queries, secrets, sharding
from tests.llm.conftest import EDGE


# ---- secrets

def brute_base(text):
    spans = []
    pattern = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    spans += [("assign", m.start(), m.end()) for m in pattern.finditer(text) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return spans


def listed(spans):
    order = {"assign": 0, "access": 1, "hex": 2}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order.get(s[0], 3))))


def test_secret_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.QUERIES["op2_secret_scan"](spark, folder).collect()
    assert len(got) == len(texts)
    assert any(r.n_assign or r.n_hex for r in got)
    for r in got:
        base = brute_base(texts[r.doc_id])
        counts = Counter(k for k, _, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (counts["assign"], counts["access"], counts["hex"])
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert set(listed(base).split(",")) <= set(r.spans.split(",")) or not base


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | len(b := n.to_bytes((n.bit_length() + 7) // 8, "big"))]) + b
    return bytes([tag]) + size + body


RSA = der(0x30, b"".join(der(2, bytes([1]) * k) for k in (1, 128, 3, 128, 64, 64, 64, 64, 64)))
PKCS8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2b\x65\x70")) + der(4, der(4, b"k" * 32)))
SSH = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", b"p" * 32))
URL = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
JWT = f"{URL({'alg': 'HS256', 'typ': 'JWT'})}.{URL({'sub': '1'})}.c2lnbmF0dXJl"


def test_structure_confirms_only_what_parses():
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(RSA).decode() + "-----END RSA PRIVATE KEY-----"
    found = {
        "jwt": JWT,
        "pem_key": pem,
        "der_key": base64.b64encode(PKCS8).decode(),
        "ssh_key": base64.b64encode(SSH).decode(),
    }
    for kind, text in found.items():
        spans = secrets.structural_spans(f"é before {text} after")
        assert (kind, 9, 9 + len(text)) in spans, kind
    assert ("der_key", 2, 2 + 2 * len(PKCS8)) in secrets.structural_spans("x " + PKCS8.hex() + " y")
    for wrong in (
        base64.b64encode(PKCS8[:-1]).decode(), base64.b64encode(RSA + b"x").decode(), base64.b64encode(SSH[:-2]).decode(),
        JWT.replace("eyJ", "eyK", 1), "M" * 64, "AAAA" * 20, "30" * 40, "eyJhbGciOiAx.eyJ.x",
        "-----BEGIN RSA PRIVATE KEY-----\nnot a key\n-----END RSA PRIVATE KEY-----",
    ):
        assert secrets.structural_spans(wrong) == [], wrong


def test_base_matches_that_fail_still_consume():
    assert secrets.base_spans("secret:token =abcdefgh") == []
    assert secrets.base_spans('API_KEY" : "a.b-c_d ſecret=abcdefg') == [("assign", 0, 19)]
    assert secrets.base_spans("AKIA" + "A" * 15 + " AKIA" + "B" * 16) == [("access", 20, 40)]
    text = "token = 0123456789abcdef01234567"
    assert secrets.base_spans(text) == [("assign", 0, 32), ("hex", 8, 32)]
    assert secrets.redact(text + " end", "assign:0:32,hex:8:32") == "[SECRET] end"


def long_keys(rng):
    """Random keys laid out like RSA-2048: PKCS #8, its public key, and an SSH blob."""
    number = lambda n: der(2, bytes([rng.randrange(1, 128)]) + rng.randbytes(n - 1))
    rsa = der(0x30, bytes.fromhex("06092a864886f70d0101010500"))
    private = der(0x30, b"\x02\x01\x00" + b"".join(number(n) for n in (257, 3, 256, 129, 129, 128, 128, 128)))
    pkcs8 = der(0x30, b"\x02\x01\x00" + rsa + der(4, private))
    public = der(0x30, rsa + der(3, b"\x00" + der(0x30, number(257) + number(3))))
    ssh = b"".join(len(f).to_bytes(4, "big") + f for f in (b"ssh-rsa", b"\x01\x00\x01", b"\x00" + rng.randbytes(256)))
    return pkcs8, public, ssh


def test_whole_keys_in_every_form():
    rng = random.Random(3)
    for _ in range(10):
        pkcs8, public, ssh = long_keys(rng)
        for key, kind in ((pkcs8, "der_key"), (public, "der_key"), (ssh, "ssh_key")):
            plain, safe = base64.b64encode(key).decode(), base64.urlsafe_b64encode(key).decode()
            forms = [plain, safe, safe.rstrip("=")]
            for width in (64, 70, 76):
                for end in ("\n", "\r\n", "\\n", "\\r\\n", "\\\\n", "\n    "):
                    forms += [end.join(t[k : k + width] for k in range(0, len(t), width)) for t in (plain, safe)]
            for form in forms:
                assert secrets.structural_spans(f"é {form} after") == [(kind, 2, 2 + len(form))], form
                assert secrets.structural_spans(f"é {form}\nafter it\n") == [(kind, 2, 2 + len(form))], form
                assert secrets.structural_spans(f"é {form[:-8]} after") == [], form
            for end in ("\n", "\\n"):
                body = end.join(plain[k : k + 64] for k in range(0, len(plain), 64))
                armour = f"-----BEGIN PUBLIC KEY-----{end}", f"{end}-----END PUBLIC KEY-----"
                assert secrets.structural_spans(body.join(armour)) == [(kind, len(armour[0]), len(armour[0]) + len(body))]
                pem = f"-----BEGIN PRIVATE KEY-----{end}{body}{end}-----END PRIVATE KEY-----"
                assert secrets.structural_spans(f'{{"key": "{pem}"}}') == [("pem_key", 9, 9 + len(pem))]


def test_a_megabyte_of_unfinished_keys_takes_seconds():
    ssh = base64.b64encode(b"\x00\x00\x00\x07ssh-rsa" + b"\x00\x00\x00\x00" * 10 + b"\x00\x00\xff\xff").decode().rstrip("=")
    der = base64.b64encode(b"\x30\x82\x7f\xff\x02\x01\x00" + b"\x02\x01\x07" * 12).decode().rstrip("=")
    own = base64.b64encode(b"openssh-key-v1\x00" + b"\x00\x00\x00\x00" * 3 + b"\x00\x0f\xff\xff" + b"\x00" * 24).decode().rstrip("=")
    pem = "-----BEGIN PRIVATE KEY-----\n" + der + "\n-----END PRIVATE KEY-----\n"
    texts = [line + "\n" for line in (ssh, der, own)] + ["-----" + line + "\n" for line in (ssh, der, own)] + [pem, "eyJhbGci.", "30" * 40 + "x ", "password ", "AAAA" * 20 + "\\n"]
    for text in texts:
        whole = text * (1_000_000 // len(text))
        started = time.process_time()
        secrets.base_spans(whole)
        secrets.structural_spans(whole)
        assert time.process_time() - started < 20, text[:40]


def test_secret_edges(edge, nothing):
    got = secrets.find_secrets(edge).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((i for i, _ in EDGE), key=repr)
    assert all(r.spans == "" for r in got)
    assert secrets.find_secrets(nothing).count() == 0


# ---- contamination

def brute_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(text, items, width=10):
    words, hit, owners = brute_words(text), set(), set()
    for item, t in items:
        w = brute_words(t)
        n = min(width, len(w))
        runs = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i : i + n]) in runs:
                hit.update(range(i, i + n))
                owners.add(item)
    return len(words), len(hit), owners - {None}


def test_contamination_query(spark, folder, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: r for r in queries.QUERIES["op3_decontamination"](spark, folder).collect()}
    hits = 0
    for row in documents.collect():
        n, hit, owners = brute_contamination(row.text, items)
        r = got.pop(row.doc_id)
        digest = hashlib.sha256(",".join(sorted(map(str, owners))).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(owners), digest, hit > 0)
        hits += hit > 0
    assert hits and not got


@pytest.mark.parametrize("block", [1, 60, 10**6])
def test_contamination_edges(spark, block):
    base = "one two three four five six seven eight nine ten eleven Zwölf"
    items = [(1, base), (2, "short Item"), (3, base), (None, "nameless one"), (4, None), (5, "..."), (6, "short item")]
    texts = [
        (1, "x " + base.upper().replace("Ö", "ö").replace(" ", "--") + " y"), (2, "a Short\n\nitem"), (3, None), (4, ""), (5, "shorts item short items"),
        (6, "nameless; one"), (7, "one two three four five six seven eight nine"), (8, base + " " + base), (8, base + " " + base),
    ]
    docs = spark.createDataFrame([(i, t, "q", 5) for i, t in texts], "doc_id long, text string, item_id string, hit_items int")
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    got = contamination.find_contamination(docs, bench, block_bytes=block).collect()
    expected = sorted((i, *brute_contamination(t, items)) for i, t in texts)
    shown = sorted((r.doc_id, r.n_words, sum(s.end - s.first for s in r.hit_spans), set(r.hit_items)) for r in got)
    assert shown == expected
    none = contamination.find_contamination(docs, bench.limit(0)).collect()
    assert sorted((r.doc_id, r.n_words) for r in none) == [e[:2] for e in expected]
    assert not any(r.hit_items or r.hit_spans for r in none)


def test_words_map_back_to_the_original():
    text = "Ünder—the; Sea é9!  x"
    spans = contamination.word_offsets(text)
    assert [text[a:b].lower() for a, b in spans] == ["ünder—the", "sea", "é9", "x"]
    assert contamination.word_offsets("") == []


# ---- quality rules

def brute_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_quality_query(spark, folder, documents):
    got = {r.doc_id: r for r in queries.QUERIES["op4_quality_rules"](spark, folder).collect()}
    for row in documents.collect():
        r = got.pop(row.doc_id)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_stats(row.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert not got


def test_quality_rules_hold_out(spark):
    """Rules learned on half of the labels find the bad rows of the other half and leave the good ones."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    stats = doc_stats.doc_stats(docs).cache()
    rules = decision_list.learn_from(stats, labels.where("doc_id % 2 = 0"))
    assert rules
    table = decision_list.with_ratios(stats).withColumn("ok", decision_list.verdict(rules)).join(labels.where("doc_id % 2 = 1"), "doc_id")
    rows = table.where("n_words >= 10 and 100 * n_repeat_words <= 20 * n_words").select("ok", "quality").collect()
    assert sum(r.ok for r in rows if r.quality == 1) >= 0.99 * sum(r.quality == 1 for r in rows)
    assert sum(not r.ok for r in rows if r.quality == 0) >= 0.9 * sum(r.quality == 0 for r in rows)
    stats.unpersist()


def test_list_in_spark_equals_list_in_numpy(spark, documents):
    stats = decision_list.with_ratios(doc_stats.doc_stats(documents))
    rules = [
        (decision_list.Condition("symbols_per_word", True, 0.3), decision_list.Condition("n_words", True, 12.0)),
        (decision_list.Condition("distinct_share", False, 0.4),),
    ]
    table = stats.withColumn("ok", decision_list.verdict(rules)).toPandas()
    x = table[list(decision_list.FEATURES)].to_numpy(float)
    expected = ~(decision_list.covered(rules[0], x) | decision_list.covered(rules[1], x))
    assert (table["ok"].to_numpy(bool) == expected).all() and not expected.all()
    assert str(rules[1][0]) == "distinct_share <= 0.4"


def test_learning_finds_a_planted_conjunction():
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(decision_list.FEATURES)))
    bad = ((x[:, 2] > 0.6) & (x[:, 4] < 0.3)) | (x[:, 7] > 0.95)
    rules = decision_list.learn(x, bad, np.arange(3000) % 3 == 2)
    hit = np.any([decision_list.covered(r, x) for r in rules], axis=0)
    assert (hit == bad).mean() > 0.99
    nothing = np.zeros((0, len(decision_list.FEATURES)))
    assert decision_list.learn(nothing, np.zeros(0, bool), np.zeros(0, bool)) == []
    assert decision_list.learn(x, np.zeros(3000, bool), np.arange(3000) % 3 == 2) == []


def test_quality_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (None, 0, 0), (9, None, 0), (7, 1, 0)], "doc_id long, quality int, text int")
    got = decision_list.judge_quality(edge, labels, keep=("doc_id", "text")).collect()
    shown = sorted(((r.doc_id, r.text, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr)
    assert shown == sorted(((i, t, *brute_stats(t)) for i, t in EDGE), key=repr)
    assert decision_list.judge_quality(nothing, labels).count() == 0
    unlabelled = decision_list.judge_quality(edge, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in unlabelled)


# ---- shards

def check_shards(rows, got, shards):
    expected = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == expected
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [r.doc_id for r in ordered]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    start = 0
    for r in ordered:
        assert r.start == start and 0 <= r.shard < shards
        start += r.size
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    largest, target = max(r.size for r in got), start / shards
    for shard in range(shards):
        assert abs(sum(r.size for r in got if r.shard == shard) - target) <= largest


def test_shards(spark, folder, documents, edge, nothing):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    check_shards(rows, sharding.contiguous_shards(documents, 40).collect(), 40)
    check_shards(EDGE, sharding.contiguous_shards(edge, 3).collect(), 3)
    assert sharding.contiguous_shards(nothing, 40).count() == 0
    got = queries.QUERIES["op6_sharding"](spark, folder).collect()
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
