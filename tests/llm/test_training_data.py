"""Training-data operators: brute force, exact round trips, held-out accuracy, and nulls, ties, repeats, clashes, nothing."""

import base64
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import conversations as C
from chronoweave.llm import leakage, mixing, secrets, similar_vectors, splitting, subjects

# --- 1. Credentials. The values are invented.

FAKE = "Qz7" + "kLm2pXv9" * 3
FOUND = [
    (f"export API_KEY={FAKE}", FAKE), (f'{{"client_secret": "{FAKE}", "n": 3}}', FAKE), (f"password: {FAKE}", FAKE), (f"<password>{FAKE}</password>", FAKE),
    (f"curl -u bob:{FAKE} https://h.invalid", FAKE), (f"GET https://h.invalid/?a=1&access_token={FAKE}&page=2", FAKE), (f"redis://svc:{FAKE}@h.invalid:1/x", FAKE),
    (f"Authorization: Basic {FAKE}=", FAKE + "="), (f"sshpass -p '{FAKE}' ssh x", FAKE), (f"mysqldump -uroot -p{FAKE} db", FAKE), (f"machine h login ci password {FAKE}", FAKE),
    (f"ENV DB_PASSWORD {FAKE}", FAKE), (f"run --password {FAKE} --dry", FAKE), (f"the password is {FAKE} , change it", FAKE), (f"secret_key   =   {FAKE}", FAKE),
    ("key AKIA" + "ABCDEFGH23456789 in use", "AKIA" + "ABCDEFGH23456789"), ("ghp_" + "a1B2c3" * 6 + " here", "ghp_" + "a1B2c3" * 6),
]
CLEAN = [
    "password: <your-password-here>", "secret_key = '********'", "token: [REDACTED]", "max_tokens: 2048", "Authorization: Bearer $TOKEN", "API_KEY=${OTHER}", 'api_key = os.environ["API_KEY"]',
    "postgres://user:{password}@{host}/x", "type Login = { user: string; password: string }", "token = next(tokens)", "digest: sha256:" + "ab12" * 16, "HEAD is now at " + "0a1b" * 10,
    "the foreign key depends on the token count", "request id 123e4567-e89b-12d3-a456-426614174000", "", "secret 'x-auth' created, etag 0123456789abcdef0123456789abcdef", "export K=sk-" + "x" * 24,
]


@pytest.mark.parametrize("text, secret", FOUND)
def test_credentials_are_found(text, secret):
    assert [text[a:b] for a, b in secrets.find(text)] == [secret]
    assert secret not in secrets.redact(text) and secrets.redact(secrets.redact(text)) == secrets.redact(text)


@pytest.mark.parametrize("name", ["AWS_SESSION_TOKEN", "ENCRYPTION_KEY", "ADMIN_TOKEN", "login_token", "subscription_key", "account-key", "VAULT_SECRET_ID", "adminToken"])
def test_names_that_only_end_like_harmless_ones_are_found(name):
    for text in (f'{name} = "q8Zt1vR5sKp2Lw9x"', f"{name}: q8Zt1vR5sKp2Lw9x"):
        assert [text[a:b] for a, b in secrets.find(text)] == ["q8Zt1vR5sKp2Lw9x"]


@pytest.mark.parametrize("text, secret", [("AccountName=a;AccountKey=q8Zt1vR5sKp2Lw9x", "q8Zt1vR5sKp2Lw9x"), ("secret_id=6f1c2a7e-0b7d-4f5e-9a51-2f6f0e3b1c88", "6f1c2a7e-0b7d-4f5e-9a51-2f6f0e3b1c88")])
def test_account_keys_and_secret_ids_are_found(text, secret):
    assert [text[a:b] for a, b in secrets.find(text)] == [secret]


def _layers(text, n):
    for _ in range(n):
        text = base64.b64encode(text.encode()).decode()
    return text


def test_short_deep_and_wrapped_layers_are_decoded():
    der = b"\x30\x82\x00\xc8" + b"\x02\x01\x00" + b"\x30\x03\x06\x01\x2a" + b"\x04\x81\xbd" + bytes(range(189))
    assert secrets.is_key_container(der)
    wrapped = base64.encodebytes(der).decode().strip()
    for text in (base64.b64encode(b"password=hunter2").decode(), _layers(f"password={FAKE}", 7), wrapped):
        assert secrets.find(text) == [(0, len(text))] and secrets.find(f"x {text}\ndone") == [(2, 2 + len(text))]


def test_quoted_values_with_blanks():
    for text in ('password = "correct horse 7 battery"', "passphrase: 'correct horse battery staple'"):
        assert len(secrets.find(text)) == 1
    for text in ('password: "Enter your password"', 'password = "must be at least 8 characters"', 'token = "some words 7 here"', 'secret: "used by service 3"'):
        assert secrets.find(text) == []


@pytest.mark.parametrize("name", ["next_page_token", "nextPageToken", "max-tokens", "cache_key", "row_key", "PRIMARY_KEY", "n_token", "user.partition_key", "auth_method", "ssh-key", "access_token_id"])
def test_harmless_names_stay(name):
    assert secrets.find(f'{name} = "q8Zt1vR5sKp2Lw9x"') == []


@pytest.mark.parametrize("text", CLEAN)
def test_other_text_stays(text):
    assert secrets.find(text) == [] and secrets.redact(text) == text


def test_key_blocks_and_layers():
    block = "-----BEGIN EC PRIVATE KEY-----\nAAAA" + "Bb1/" * 8 + "\n-----END EC PRIVATE KEY-----"
    assert [("x " + block + " y")[a:b] for a, b in secrets.find("x " + block + " y")] == [block]
    inner = f"password={FAKE}"
    for wrap in (lambda s: base64.b64encode(s.encode()).decode(), lambda s: s.encode().hex(), lambda s: "".join(f"%{c:02X}" for c in s.encode()), lambda s: "".join(f"\\x{c:02x}" for c in s.encode())):
        once = wrap(inner)
        assert [f"v {once} w"[a:b] for a, b in secrets.find(f"v {once} w")] == [once]
        twice = base64.b64encode(once.encode()).decode()
        assert secrets.find(twice) == [(0, len(twice))]
    harmless = base64.b64encode(b"nothing of interest is in this text at all").decode()
    assert secrets.find(harmless) == []


def test_a_credential_said_again_is_found_again():
    raw = json.dumps({"content": [{"type": "text", "text": f"password: {FAKE}"}, {"type": "text", "text": f"later {FAKE} once more"}, {"type": "tool_use", "input": {"x": FAKE}}]})
    found, out = secrets.scan_message(raw)
    assert found == [(0, FAKE), (1, FAKE)] and out.count(FAKE) == 1 and json.loads(out)["content"][2]["input"]["x"] == FAKE
    assert [f"I reused {FAKE} from above."[a:b] for a, b in secrets.find(f"I reused {FAKE} from above.")] == [FAKE]


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82, n >> 8, n & 255])) + body


def test_key_containers_by_grammar():
    numbers = [der(2, bytes([1]) + bytes(range(40)))] * 8
    pkcs1 = der(0x30, der(2, b"\0") + b"".join(numbers))
    pkcs8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48")) + der(4, pkcs1))
    assert secrets.is_key_container(pkcs1) and secrets.is_key_container(pkcs8) and not secrets.is_key_container(b"openssh-key-v1\0xyz")
    assert not secrets.is_key_container(der(0x30, der(2, b"\0") + numbers[0])) and not secrets.is_key_container(pkcs8[:-1]) and not secrets.is_key_container(b"")
    text = "blob " + base64.b64encode(pkcs8).decode() + " end"
    assert [text[a:b] for a, b in secrets.find(text)] == [text.split()[1]]


def test_only_the_literal_in_scope_is_rewritten():
    said = 'API_KEY="q8Zt1vR5sKp2Lw9x"'
    raw = json.dumps({"content": [{"type": "tool_use", "input": {"x": said}}, {"type": "text", "text": said}]})
    found, out = secrets.scan_message(raw)
    assert found == [(1, "q8Zt1vR5sKp2Lw9x")]
    items = json.loads(out)["content"]
    assert items[0]["input"]["x"] == said and items[1]["text"] == 'API_KEY="[REDACTED]"'


def test_characters_around_a_credential_stay_as_they_were_written():
    raw = '{"z": [1, {"content": "x"}], "content":"a\\u00e9 \\ud83d\\ude00 password = \\"q8Zt1vR5sKp2Lw9x\\" \\/ done"}'
    assert secrets.scan_message(raw)[1] == raw.replace("q8Zt1vR5sKp2Lw9x", "[REDACTED]")


def test_containers_need_their_whole_grammar():
    string = lambda b: len(b).to_bytes(4, "big") + b
    key = b"openssh-key-v1\0" + string(b"none") + string(b"none") + string(b"") + (1).to_bytes(4, "big") + string(b"public") + string(b"private")
    assert secrets.is_key_container(key)
    assert not secrets.is_key_container(b"openssh-key-v1\0xx") and not secrets.is_key_container(key + b"x") and not secrets.is_key_container(key[:-1])
    integer = lambda n: b"\x02\x01" + bytes([n])
    dsa = b"\x30\x12" + b"".join(integer(n) for n in (0, 5, 7, 9, 11, 13))
    assert secrets.is_key_container(dsa) and not secrets.is_key_container(b"\x30\x0f" + dsa[2:17])
    safe = b"\x30\x0d" + b"\x06\x09" + bytes.fromhex("2a864886f70d010701") + b"\xa0\x00"
    safe = b"\x30" + bytes([len(safe[2:])]) + safe[2:]
    assert secrets.is_key_container(b"\x30" + bytes([3 + len(safe)]) + integer(3) + safe)
    putty = "PuTTY-User-Key-File-2: ssh-rsa\nEncryption: none\nComment: me\nPublic-Lines: 1\nAAAA\nPrivate-Lines: 1\nBBBB\nPrivate-MAC: 0f"
    assert secrets.is_key_container(putty.encode()) and not secrets.is_key_container(b"PuTTY-User-Key-File-2: ssh-rsa")
    assert secrets.redact("see " + putty + " end") == "see [REDACTED] end"


def test_wide_text_is_decoded():
    literal = base64.b64encode('password = "q8Zt1vR5sKp2Lw9x"'.encode("utf-16")).decode()
    assert secrets.redact(f"data: {literal}") == "data: [REDACTED]"


@pytest.mark.parametrize("text", ["our vault unlocks with Hq7!zRt0pWm2 these days", "the new pin for the door is tB92kQx7Lw", "people connect as root with 5Zr-Jq0vXw8T there"])
def test_running_text_gives_credentials_away(text):
    assert "[REDACTED]" in secrets.redact(text)


@pytest.mark.parametrize("text", ["use Ubuntu-22.04 with the token cache", "the key is in ConfigLoader2 now", "log in to build-host-12 with your account", "the token moved to https://a.example/X9yZ8w7V6u"])
def test_names_and_versions_in_running_text_stay(text):
    assert secrets.redact(text) == text


def test_messages_keep_everything_else(spark):
    rows = [
        (1, json.dumps({"content": f"é password: {FAKE}"})), (2, '{ "content" : [ {"type":"tool_use","input":{"password":"%s"}} , {"type": "text", "text": "token=%s \\u00e9\\n"} ] }' % (FAKE, FAKE)),
        (3, '{"content": [{"type": "tool_result", "content": [{"type": "text", "text": "PW=%s"}]}]}' % FAKE), (4, "{broken password: " + FAKE), (5, None), (6, ""), (7, "[1]"), (8, '{"content": 5}'),
        (1, json.dumps({"content": f"é password: {FAKE}"})),
    ]
    df = spark.createDataFrame(rows, "line_id bigint, message string").withColumn("secret", F.lit("clash"))
    assert sorted(map(tuple, secrets.credentials(df).collect())) == [(1, 0, FAKE), (1, 0, FAKE), (2, 1, FAKE), (3, 0, FAKE)]
    out = {r.line_id: r for r in secrets.redact_messages(df).collect()}
    assert json.loads(out[1].message) == {"content": "é password: [REDACTED]"} and out[1].n_secrets == 1
    assert out[2].message == rows[1][1].replace('"token=' + FAKE, '"token=[REDACTED]')
    assert [out[i].message for i in (4, 5, 6, 7, 8)] == [rows[i][1] for i in (3, 4, 5, 6, 7)]
    assert secrets.credentials(df.limit(0)).count() == 0


# --- 4. Conversations.

LINE = "src_session string, line_offset bigint, line_id bigint, rec_type string, rec_timestamp string, is_sidechain boolean, message string, ingested_at timestamp"


def lines(spark, rows):
    import datetime as dt

    full = []
    for i, r in enumerate(rows):
        s, off, who, t, said = r[:5]
        full.append((s, off, i, who, t, r[5] if len(r) > 5 else None, said if said is None or said.startswith("{") else json.dumps({"content": said}), dt.datetime(2025, 1, 1)))
    return spark.createDataFrame(full, LINE).withColumn("t", F.lit("clash"))


def test_session_verdicts(spark):
    at = lambda m: f"2025-01-01T00:{m:02d}:00Z"
    rows = [
        ("good", 0, "user", at(0), "ask"), ("good", 1, "assistant", at(1), "answer"), ("good", 2, "user", at(2), "  "), ("good", 3, "system", "bad", None), ("good", 4, "user", "bad", "{x", True),
        ("json", 0, "user", at(0), "{x"), ("json", 1, "assistant", at(1), "a"), ("null", 0, "user", at(0), None), ("time", 0, "user", "06/20/2026 14:02", "a"), ("time", 1, "assistant", at(1), "b"),
        ("empty", 0, "user", at(0), "  "), ("empty", 1, "assistant", at(1), '{"content": [{"type": "text", "text": " "}]}'), ("start", 0, "assistant", at(0), "a"), ("start", 1, "user", at(1), "b"),
        ("end", 0, "user", at(0), "a"), ("two", 0, "user", at(0), "a"), ("two", 1, "user", at(1), "b"), ("two", 2, "assistant", at(2), "c"),
        ("zone", 0, "user", "2025-01-01T05:00:00+05:00", "a"), ("zone", 9, "assistant", "2025-01-01T00:00:00.5Z", "b"), ("tie", 5, "assistant", at(0), "b"), ("tie", 2, "user", at(0), "a"),
        ("night", 0, "user", "2025-01-01T23:59:00Z", "a"), ("night", 1, "user", "2025-01-02T00:01:00Z", "b"), ("night", 2, "assistant", "2025-01-02T00:02:00Z", "c"), ("none", 0, "summary", None, None),
        ("good", 0, "user", at(0), "ask"), (None, 0, "user", at(0), "a"), ("tool", 0, "user", at(0), '{"content": [{"type": "tool_result", "content": ""}]}'), ("tool", 1, "assistant", at(1), '{"content": [{"type": "tool_use", "input": {}}]}'),
    ]
    slim = C.message_lines(lines(spark, rows)).cache()
    got = {r.src_session: r.reason for r in C.session_verdicts(slim, C.reply_links(slim)).collect()}
    assert got == {"good": None, "json": "broken", "null": "broken", "time": "broken", "empty": "empty", "start": "starts_without_user", "end": "ends_without_reply", "two": "missing_reply", "zone": None, "tie": None, "night": "missing_reply", "none": "empty", "tool": None}


def test_threads_follow_mentions_and_words(spark):
    at = lambda m: f"2025-01-01T00:{m:02d}:00Z"
    rows = [
        ("s", 0, "user", at(0), "please restart host-12 quickly"), ("s", 1, "assistant", at(1), "restarting host-12 now"), ("s", 2, "user", at(50), "which colour has the logo"), ("s", 3, "assistant", at(51), "the logo colour is green"),
        ("n", 0, "user", "2025-01-01T23:59:00Z", "alpha beta gamma"), ("n", 1, "assistant", "2025-01-02T00:01:00Z", "alpha beta gamma indeed"), ("n", 2, "user", "2025-01-02T00:02:00Z", "alpha beta gamma again"), ("n", 3, "assistant", "2025-01-02T00:03:00Z", "alpha beta gamma done"),
    ]
    turns, sessions = C.conversations(lines(spark, rows))
    got = {(r.src_session, r.turn_no): r for r in turns.collect()}
    assert got[("s", 2)].parent_line == 0 and got[("s", 4)].parent_line == 2 and got[("s", 1)].parent_line is None
    assert {got[("n", i)].thread for i in (1, 2, 3, 4)} == {4} and [got[("s", i)].role for i in (1, 2)] == ["user", "assistant"]
    assert sessions.where("reason IS NULL").count() == 2
    t, s = C.conversations(lines(spark, rows).limit(0))
    assert t.count() == 0 and s.count() == 0


@pytest.mark.parametrize("stretch", [2048, 20, 7])
def test_reply_links_against_brute_force(spark, monkeypatch, stretch):
    import datetime as dt
    import math
    import re

    monkeypatch.setattr(C, "STRETCH", stretch)
    rnd = random.Random(4)
    vocab = [f"word{i}x" for i in range(3_000)]
    rows, at = [], dt.datetime(2025, 1, 1, 22, 0, tzinfo=dt.UTC)
    topics = [(rnd.sample(vocab, 400), f"host-{k}") for k in range(14)]
    for n in range(150):
        at += dt.timedelta(seconds=rnd.choice([5, 20, 60, 200] if n % 40 or not n else [9_000]))
        words, host = topics[rnd.randrange(14)]
        text = " ".join([*rnd.sample(words, rnd.choice([3, 30, 390])), *([host] if rnd.random() < 0.5 else [])])
        rows.append(("s", n, "user" if n % 2 == 0 else "assistant", at.strftime("%Y-%m-%dT%H:%M:%SZ"), text))
    want, thread, furthest = {}, {}, 0
    sets = [(set(re.findall(C.WORD.replace(r"\p{L}\p{N}", "a-z0-9"), r[4])), set(re.findall(C.MENTION, r[4])), dt.datetime.fromisoformat(r[3])) for r in rows]
    for i, (w, m, t) in enumerate(sets):
        best, parent = None, None
        for j in range(i - 1, -1, -1):
            gap = (t - sets[j][2]).total_seconds()
            score = (i - j) % 2 + math.exp(-gap / 600) + 1.5 * len(m & sets[j][1]) / max(1, min(len(m), len(sets[j][1]))) + 2 * len(w & sets[j][0]) / max(1, math.sqrt(len(w) * len(sets[j][0]))) - 0.05 * (i - j)
            if score >= 0.9 and (best is None or score > best):
                best, parent = score, j
        want[i] = (parent, best)
        thread[i] = i if parent is None else thread[parent]
        furthest = max(furthest, i - parent if parent is not None else 0)
    got = {r.line_id: r for r in C.conversations(lines(spark, rows))[0].collect()}
    assert furthest > 8 and len(got) == 150 and sets[0][2].day != sets[-1][2].day
    assert {i: r.parent_line for i, r in got.items()} == {i: p for i, (p, _) in want.items()}
    assert all(r.score is None if want[i][1] is None else abs(r.score - want[i][1]) < 1e-9 for i, r in got.items())
    assert {i: r.thread for i, r in got.items()} == thread and {i: r.turn_no for i, r in got.items()} == {i: i + 1 for i in got}
    assert any(p is not None and (sets[i][2] - sets[p][2]).total_seconds() > 7200 for i, (p, _) in want.items())


# --- 6. Vectors.


def test_mutual_pairs_and_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 32)).astype("float32")
    x[700:800] = x[:100] + rng.normal(size=(100, 32)).astype("float32") * 0.25
    x[800:830] = x[5]  # a crowd of copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 32), (9002, [1.0]), (9003, [float("nan")] * 32), (None, [1.0] * 32), (3, x[3].tolist())]
    df = spark.createDataFrame(rows, "fact_id bigint, vec array<float>").withColumn("id", F.lit("clash"))
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    order = np.lexsort((np.broadcast_to(np.arange(len(u)), s.shape), -np.round(s, 12)), axis=1)[:, :10]
    near = [set(o.tolist()) for o in order]
    want = {(i, j) for i in range(len(u)) for j in near[i] if i < j and i in near[j] and s[i, j] >= 0.9}
    got = {(r.a, r.b) for r in similar_vectors.mutual_pairs(df, rows_per_cell=100).collect()}
    assert len(want) > 80 and len(got & want) >= 0.99 * len(want) and not got - want
    top = similar_vectors.top_k(df, queries=F.col("id") % 50 == 0, rows_per_cell=100, recall=0.995).collect()
    hit = [len({r.id for r in top if r["query"] == i} & near[i]) / 10 for i in range(0, 700, 50) if i not in (5,)]
    assert np.mean(hit) >= 0.9 and {r["query"] % 50 for r in top} == {0}
    none = df.where("fact_id > 8999")
    assert similar_vectors.mutual_pairs(none.where("vec IS NULL")).count() == 0 and similar_vectors.top_k(df.limit(0)).count() == 0


def test_a_crowd_of_near_copies_is_settled_exactly(spark, monkeypatch):
    monkeypatch.setattr(similar_vectors, "CROWD", 12)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(300, 16)), rng.normal(size=16) + rng.normal(size=(150, 16)) * 0.05]).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "fact_id bigint, vec array<float>")
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    near = [set(o.tolist()) for o in np.lexsort((np.broadcast_to(np.arange(len(u)), s.shape), -s), axis=1)[:, :10]]
    want = {(i, j) for i in range(len(u)) for j in near[i] if i < j and i in near[j] and s[i, j] >= 0.9}
    assert len(want) > 300 and {(r.a, r.b) for r in similar_vectors.mutual_pairs(df).collect()} == want


def test_exact_search_is_brute_force(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(200, 8)).astype("float32")
    x[50:60] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "fact_id bigint, vec array<float>")
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -2)
    order = np.lexsort((np.broadcast_to(np.arange(200), s.shape), -s), axis=1)[:, :10]
    got = {(r["query"], r["rank"]): r.id for r in similar_vectors.top_k(df, queries=F.col("id") % 50 == 0, exact=True).collect()}
    assert got == {(q, k + 1): int(order[q, k]) for q in range(0, 200, 50) for k in range(10)}


def test_cells_grow_with_the_root():
    assert [similar_vectors.cells_for(n) for n in (10, 40_000, 640_000, 10**8)] == [1, 100, 1600, 20_000]


# --- 7. Splitting.


@pytest.mark.parametrize("limit, overlap", [(6000, 500), (200, 40), (60, 0), (12, 8)])
def test_pieces_join_to_the_text(spark, limit, overlap):
    rnd = random.Random(limit)
    words = ["alpha", "βήτα", "漢字漢字", "x" * 300, "\r\n\r\n", "\n\n", "\n", "😀", "USER: hi", "\n\nASSISTANT: yes", "\t", " "]
    texts = [None, "", "a", "漢" * 5000, "y" * 9000, "\n" * 500] + ["".join(rnd.choice(words) + rnd.choice(["", " "]) for _ in range(rnd.choice([3, 60, 600]))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id bigint, text string").withColumns({"end_offset": F.lit(7), "piece": F.lit("clash"), "body": F.lit("b"), "at": F.lit("c")})
    got = {}
    for r in splitting.split_text(df, limit=limit, overlap=overlap).collect():
        got.setdefault(r.chunk_id, []).append(r)
        assert r.end_offset == 7 and r.at == "c"
    for i, t in enumerate(texts):
        rows = sorted(got.get(i, []), key=lambda r: r.piece_no)
        if not t:
            assert not rows
            continue
        b = t.encode()
        assert b"".join(r.piece.encode()[r.overlap_bytes :] for r in rows) == b and len(rows) == rows[0].n_pieces
        for r in rows:
            assert len(r.piece.encode()) <= limit and r.overlap_bytes <= overlap
            assert b[r.start_byte : r.end_byte].decode() == r.piece and t[r.start_char :].startswith(r.piece)
        assert len(rows) == 1 or len(b) > limit


def test_cuts_fall_between_turns(spark):
    t = "\n\n".join(("USER: " if i % 2 else "ASSISTANT: ") + "word " * 20 for i in range(10))
    rows = splitting.split_text(spark.createDataFrame([(1, t)], "id bigint, text string"), limit=300, overlap=120).orderBy("piece_no").collect()
    assert len(rows) > 3 and all(r.piece.startswith(("USER: ", "ASSISTANT: ")) for r in rows) and all(r.overlap_bytes > 0 for r in rows[1:])


# --- 8. Leaks.


@pytest.mark.parametrize("table", [10**6, 0])
def test_leaks_with_edits(spark, monkeypatch, table):
    monkeypatch.setattr(leakage, "TABLE_GRAMS", table)
    rnd = random.Random(1)
    vocab = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9))) for _ in range(900)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(60))) for i in range(30)]
    noise = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))

    def edited(words, k):
        w = list(words)
        for p in rnd.sample(range(2, len(w) - 2), k):
            w[p] = rnd.choice(["zzzz", w[p] + " extra", ""])
        return w

    docs, want = [], set()
    for d in range(120):
        item, text = items[d % 30]
        w = text.split()
        n, a = rnd.choice([(12, 0), (18, 0), (30, 0), (30, 2), (60, 4), (60, 0), (40, 9)]), 0
        a = rnd.randint(0, 60 - n[0])
        part = edited(w[a : a + n[0]], n[1])
        style = rnd.choice([" ".join, lambda x: "\n> ".join(x).upper(), lambda x: "_".join(x).replace("_", " -- ")])
        docs.append((d, f"{noise(40)} {style([p for p in part if p])} {noise(30)}"))
        if n[0] >= 30 and n[1] <= n[0] // 10:
            want.add((d, item))
    docs += [(500, None), (501, ""), (None, "x"), (502, noise(3000)), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    ev = spark.createDataFrame(items + [(97, None), (98, "!!"), (0, items[0][1])], "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(df, ev).collect()}
    assert got == want
    assert leakage.leaks(df, ev.limit(0)).count() == 0 and leakage.leaks(df.limit(0), ev).count() == 0


def test_a_long_word_in_a_passage(spark):
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9))) for _ in range(900)]
    item = [rnd.choice(vocab) for _ in range(60)]
    part = item[10:36]
    texts = [part[:13] + [x] + part[13:] for x in ("ab", "x" * 90, "y" * 3000)] + [part[:13] + ["z" * 500] + part[14:], part[:10] + ["w" * 70] + part[10:20] + ["v" * 40] + part[20:], part[:8]]
    df = spark.createDataFrame([(i, " ".join(rnd.choice(vocab) for _ in range(200)) + " " + " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    ev = spark.createDataFrame([(1, " ".join(item)), (2, "q" * 40 + " " + " ".join(rnd.choice(vocab) for _ in range(30)))], "item_id bigint, text string")
    rows = {r.doc_id: r for r in leakage.leaks(df, ev).collect()}
    assert set(rows) == {0, 1, 2, 3, 4} and all(r.item_id == 1 and r.words >= 24 for r in rows.values())


def test_alignment_in_a_band_is_the_whole_one():
    rnd = random.Random(6)
    for _ in range(40):
        item = [rnd.randrange(6) for _ in range(rnd.randint(1, 25))]
        doc = [rnd.randrange(6) for _ in range(rnd.randint(1, 25))]
        best = 0
        h = [[0] * (len(doc) + 1) for _ in range(len(item) + 1)]
        for i, x in enumerate(item, 1):
            for j, y in enumerate(doc, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                best = max(best, h[i][j])
        path = leakage.align(item, doc, 0, 60)
        assert sum(2 if same else -1 for _, _, same in path) == best
        assert all(same == (i >= 0 and j >= 0 and item[i] == doc[j]) for i, j, same in path)


# --- 9. Mixing.


@pytest.mark.parametrize("seed", range(6))
def test_fit_budget_is_exact(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 900, 60))
    counts = rng.integers(0, 500, len(lengths))
    total = int((lengths * counts).sum())
    for budget in (0, 1, total // 3, total - 1, total, total + 5):
        take = mixing.fit_budget(lengths, counts, budget, seed)
        spent = int((take * lengths).sum())
        assert (take >= 0).all() and (take <= counts).all() and spent <= budget
        if 2000 < budget < total - 2000:
            assert spent == budget
    small = mixing.fit_budget(np.array([3, 5]), np.array([1, 1]), 7)
    assert list(small) == [0, 1]
    assert list(mixing.fit_budget(np.array([150_000]), np.array([1]), 149_999)) == [0]
    assert list(mixing.fit_budget(np.array([150_000]), np.array([3]), 310_000)) == [2]
    assert list(mixing.fit_budget(np.array([7, 150_000, 400_000]), np.array([4, 3, 2]), 560_021)) == [4, 1, 1]


def test_mix_reaches_shares_and_caps(spark):
    rnd = random.Random(2)
    docs = [(i, " ".join(["word"] * rnd.randint(1, 30)), rnd.choice(["big", "BIG ", "big-one", "small"] if i % 9 == 0 else ["big"])) for i in range(900)] + [(5000, None, "big"), (5001, "", "big"), (5002, "x", None), (None, "x", "big"), (0, "word", "big")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("uses", F.lit("clash"))
    t = spark.createDataFrame([("big", 0.5, 2), ("small", 0.3, 3), ("absent", 0.2, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(df, t)
    r = {x.source: x for x in report.collect()}
    assert abs(r["big"].actual_share - 0.625) < 0.01 and abs(r["small"].actual_share - 0.375) < 0.01 and r["absent"].tokens == 0
    assert [s for s, x in r.items() if x.sets_size] == ["small"]
    rows = chosen.collect()
    assert len({x.doc_id for x in rows}) == len(rows) and all(1 <= x.uses <= {"big": 2, "small": 3}[x.source] for x in rows)
    over = {x.source: x for x in mixing.mix(df, t, total_tokens=10**7)[1].collect()}
    assert over["small"].uses == 3 * over["small"].documents  # at its cap
    assert mixing.mix(df.limit(0), t)[0].count() == 0 and mixing.mix(df, t.limit(0))[1].count() == 0


# --- 10. Subjects.


@pytest.mark.parametrize("block_rows, table_rows", [(2000, 10**6), (100, 10**6), (2000, 0)])
def test_subjects_on_held_out_documents(spark, monkeypatch, block_rows, table_rows):
    monkeypatch.setattr(subjects, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(subjects, "TABLE_ROWS", table_rows)
    rnd = random.Random(4)
    terms = {s: [f"{s}{a} {s}{b}" for a in ("alpha", "beta", "gamma") for b in ("node", "ring", "cell")] for s in ("law", "bio", "net")}
    shared = ["field map", "token count", "pool size", "stage plan"]

    def say(s):
        return rnd.choice(["The {} depends on the {}.", "Keep the {} and drop the {}."]).format(rnd.choice(terms[s]), rnd.choice(terms[s] + shared))

    docs, truth, labels = [], {}, []
    for i in range(300):
        own = rnd.sample(list(terms), rnd.choice([1, 1, 1, 2, 0]))
        text = ["Thanks, that helps.", "See you soon."] + [say(s) for s in own for _ in range(4)]
        docs.append((i, "\n".join(text)))
        truth[i] = set(own)
        if i % 5 == 0:
            labels += [(i, s) for s in (own if i % 45 else ["law"])]
    docs += [(900, None), (901, ""), (None, "x"), (902, "Nothing here at all."), (1, docs[1][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("subject", F.lit("clash"))
    lb = spark.createDataFrame(labels + labels[:3] + [(None, "law"), (7, None)], "doc_id bigint, subject string")
    got = {}
    for r in subjects.subjects_of(df, lb).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i, set()) == t for i, t in truth.items() if i % 5)
    assert right >= 0.95 * sum(1 for i in truth if i % 5) and 902 not in got and 901 not in got


def test_subjects_leave_eval_passages_aside(spark):
    text = "The lawalpha node binds the lawbeta ring of every clause.\nSee you."
    df = spark.createDataFrame([(i, text if i < 9 else "See you.\nThe bioalpha cell grows in the biobeta ring.") for i in range(18)], "doc_id bigint, text string")
    lb = spark.createDataFrame([(i, "law" if i < 9 else "bio") for i in range(18)], "doc_id bigint, subject string")
    items = spark.createDataFrame([(1, "The lawalpha node binds the lawbeta ring of every clause.")], "item_id bigint, text string")
    assert subjects.subjects_of(df, lb, rounds=2).count() == 18 and {r.subject for r in subjects.subjects_of(df, lb, items, rounds=2).collect()} == {"bio"}
    assert subjects.subjects_of(df, lb.limit(0)).count() == 0 and subjects.subjects_of(df.limit(0), lb).count() == 0


def test_edges_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(subjects, "KEPT", 99)
    rnd = random.Random(3)
    profiles = {d: set(rnd.sample(range(1, 25), rnd.randint(2, 8))) for d in range(12)}
    rows = [(d, sorted(ps), sorted(ps)) for d, ps in profiles.items()]
    edges = {(r.doc_id, r.other): r.weight for r in subjects.similar_documents(spark.createDataFrame(rows, "doc_id bigint, profile array<int>, lead array<int>")).collect()}
    cosine = {(a, b): len(profiles[a] & profiles[b]) / (len(profiles[a]) * len(profiles[b])) ** 0.5 for a in profiles for b in profiles if a != b}
    assert edges == {k: round(64 * c) for k, c in cosine.items() if c >= subjects.LEAST_COSINE}


def test_both_ways_to_look_phrases_up_agree(spark, monkeypatch):
    rnd = random.Random(7)
    vocab = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    text = lambda: "\n".join(" ".join(rnd.choice(vocab) for _ in range(8)) + "." for _ in range(6))
    worded = subjects._worded(spark.createDataFrame([(i, text()) for i in range(60)], "doc_id bigint, text string"))
    weights = spark.createDataFrame([(i, i % 3, subjects.ONE) for i in range(60)], "doc_id bigint, subject int, w int")
    monkeypatch.setattr(subjects, "PURITY", {1: 0.3, 2: 0.3})
    pure = subjects.materialize(subjects._pure(worded, weights))
    one = sorted(map(tuple, subjects._profiles(worded, pure).collect()))
    monkeypatch.setattr(subjects, "TABLE_ROWS", 0)
    assert one and sorted(map(tuple, subjects._profiles(worded, pure).collect())) == one


def test_a_crowd_with_one_profile_is_divided(spark, monkeypatch):
    monkeypatch.setattr(subjects, "BLOCK_ROWS", 20)
    edges = subjects.similar_documents(spark.createDataFrame([(d, [2, 4, 6], [2, 4]) for d in range(300)], "doc_id bigint, profile array<int>, lead array<int>"))
    assert edges.select("doc_id").distinct().count() == 300 and edges.where("weight <> 64").count() == 0


def test_no_partner_of_a_crowd_is_dropped(spark, monkeypatch):
    rnd = random.Random(8)
    profiles = {d: {7} | set(rnd.sample(range(10, 90), rnd.randint(0, 6))) for d in range(60)}
    frame = spark.createDataFrame([(d, sorted(ps), [7]) for d, ps in profiles.items()], "doc_id bigint, profile array<int>, lead array<int>")
    cosine = {(a, b): len(profiles[a] & profiles[b]) / (len(profiles[a]) * len(profiles[b])) ** 0.5 for a in profiles for b in profiles if a != b}
    monkeypatch.setattr(subjects, "BLOCK_ROWS", 20)
    assert {(r.doc_id, r.other): r.weight for r in subjects.similar_documents(frame).collect()} == {k: round(64 * c) for k, c in cosine.items()}
    labels = [(d, d % 3, subjects.ONE) for d in range(20)] + [(d, s, subjects.ONE // 2) for d in range(20, 30) for s in (1, 4)]
    sums = {}
    for (a, b), c in cosine.items():
        for d, s, w in labels:
            if d == b:
                sums[a, s] = sums.get((a, s), 0) + c * w
    total = {a: sum(v for (d, _), v in sums.items() if d == a) for a in profiles}
    for rows in (10**6, 0):
        monkeypatch.setattr(subjects, "TABLE_ROWS", rows)
        got = {(r.doc_id, r.subject): r.w for r in subjects.phrase_votes(frame, spark.createDataFrame(labels, "doc_id bigint, subject int, w int")).collect()}
        assert got.keys() == sums.keys() and all(abs(got[k] - subjects.ONE * v / total[k[0]]) <= 1 for k, v in sums.items())


def test_wrong_seeds_are_not_trusted(spark):
    edges = spark.createDataFrame([(a, b, 40) for a in range(6) for b in range(6) if a != b], "doc_id bigint, other bigint, weight int")
    seeds = spark.createDataFrame([(d, 0 if d else 1, subjects.ONE) for d in range(5)], "doc_id bigint, subject int, w int")
    got = {(r.doc_id, r.subject): r.w for r in subjects.propagate(edges, seeds, seeds, 2)[0].collect()}
    assert got.get((0, 1), 0) < 200 and got[(0, 0)] > 800 and all(got[(d, 0)] >= subjects.ONE // 2 for d in range(1, 5)) and (5, 0) in got
