import hashlib
import random
import re
import string
import time

import public_tokenizers

from quillstone.llm.secrets import SecretScan, pattern_spans, random_spans, redact, scan_secrets

SCAN = SecretScan(public_tokenizers.path("byte_bpe_50k.tiktoken"))
KEY = "kZ7qW2xP9vT4mB1nR8sL5dF3"


def by_definition(text):
    rules = [
        ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    ]
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(rules) for m in p.finditer(text) if ok(m)]
    return sorted(found)


def test_patterns_equal_their_definition():
    cases = [
        "", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "token: secret: abcdefghijklmnop", "API_KEY=abcdefghijkl",
        "apikey==abcdefghijk", "toKen = abcdefghijklmnop", "ſecret=abcdefghijklmnop", "AKIAAKIA" + "B" * 20, "AKIA" + "B" * 13,
        "é" * 5 + "0123456789abcdef" + "AKIA0123456789ABCD", "password'  =  'hunter2hunter2'", "0" * 15 + "g" + "f" * 16,
    ]
    for text in cases:
        assert pattern_spans(text) == by_definition(text), text


def found_in(text):
    return [text[a:b] for a, _, b in random_spans(text, pattern_spans(text), SCAN)]


def test_random_strings_are_found_and_words_are_not():
    rng = random.Random(4)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    for alphabet, least in ((string.ascii_letters + string.digits, 0.99), (string.ascii_lowercase + string.digits, 0.95), (string.ascii_letters, 0.95), (string.ascii_lowercase, 0.85)):
        for n in (20, 32, 48):
            secrets = [draw(alphabet, n) for _ in range(200)]
            for frame in ("{}", "see {}, ok", "//files.example.com/download/manuals/{}", "authorization_bearer_credential={}"):
                assert sum(found_in(frame.format(x)) in ([x], [f"{frame[:-2]}{x}"]) or x in "".join(found_in(frame.format(x))) for x in secrets) >= least * 200, (alphabet, n, frame)
    words = "internationalization counterrevolutionaries Bundesverfassungsgericht electroencephalograph getElementsByClassName AbstractSingletonProxyFactoryBean desafortunadamente /usr/share/documentation/configuration.example.html 2023-01-01T00:00:00 1.22.333.4444.55555.666666 4572801887383181 123e4567-e89b-12d3-a456-426614174000"
    assert found_in(words) == []


def test_what_patterns_found_is_left_out_of_runs():
    key = KEY + "Qm"
    assert found_in(f"token={key}") == [] and found_in(f"{key}/token={key}/{key}") == [key]
    hexed = "0123456789abcdef0123"
    assert pattern_spans(f"{key}.{hexed}.{key}") and found_in(f"{key}.{hexed}.{key}") == [key, key]


def test_many_secrets_in_one_text():
    text = " ".join(f"token = abcdefghijkl{i:06d} {KEY}" for i in range(18_000))
    began = time.process_time()
    assert len(pattern_spans(text)) == len(found_in(text)) == 18_000
    assert time.process_time() - began < 3


def test_scan(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, f"see {KEY} here", "z"), (3, f"see {KEY} here", "z"), (4, "d41d8cd98f00b204e9800998ecf8427e", "u"), (5, "word " * 50_000 + KEY, "v"), (6, "123e4567-e89b-12d3-a456-426614174000 internationalization-friendly.documentation", "w")]
    got = sorted(scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string"), SCAN).collect())
    assert [r.doc_id for r in got] == [1, 2, 3, 3, 4, 5, 6]
    assert [r.spans for r in got] == ["", "", "random:4:28", "random:4:28", "hex:0:32", "random:250000:250024", ""]
    assert scan_secrets(spark.createDataFrame([], "doc_id long, text string"), SCAN).collect() == []
    assert redact(rows[2][1], got[2].spans) == "see [secret] here"


def test_query(spark):
    from quillstone.llm.queries import op1_secret_scan
    from quillstone.llm.secrets import joined

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = op1_secret_scan(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    for r in got:
        base = by_definition(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
