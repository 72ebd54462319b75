"""Manifest, secret scan and conversation trie against plain versions."""

import base64
import bz2
import gzip
import hashlib
import random
import re
import zlib

import duckdb
import pytest

from oreline.llm import merkle, prefix_trie, secrets, smaller_values, structure_queries
from oreline.storage import Passes


def same_as_sql(frame, sql, table, source):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM {source}") if isinstance(source, str) else con.register(table, source)
    want = con.sql(sql)
    names = sorted(want.columns)
    assert sorted(frame.columns) == names
    return sorted(map(repr, map(tuple, frame.select(*names).collect()))), sorted(map(repr, want.project(", ".join(names)).fetchall()))


# Manifest


def H(nodes):
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def naive_tree(leaves):
    """Root and, per leaf, its siblings level by level."""
    level, groups, proofs = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(level) > 1:
        up, below = [], []
        for at in range(0, len(level), 8):
            run = level[at : at + 8]
            for j, members in enumerate(groups[at : at + 8]):
                for leaf in members:
                    proofs[leaf] += run[:j] + run[j + 1 :]
            up.append(H(run))
            below.append([x for g in groups[at : at + 8] for x in g])
        level, groups = up, below
    return level[0], proofs


def naive_leaf(row):
    return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]))


def naive_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        by[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, naive_leaf(r)))
        trees[g] = naive_tree([naive_leaf(r) for r in by[g]])
    root, over = naive_tree([trees[g][0] for g in order])
    return [(r["doc_id"], naive_leaf(r), trees[g][0], root, H(trees[g][1][i] + over[k])) for k, g in enumerate(order) for i, r in enumerate(by[g])]


MANIFEST_DDL = "doc_id long, source string, lang string, n_chars long, text string, grp string, pos int, proof int, row int"


def test_manifest_of_odd_rows(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, i, i % 7]), rnd.choice([None, "", "wéb"]), rnd.choice([None, "", "de", "en", "en", "en", "zh"]), rnd.choice([None, i]), rnd.choice([None, "", "Ab c", "é" * 50]), "x", 1, 2, 3) for i in range(700)]
    rows += [(5, "a", "en", 1, "same", "x", 1, 2, 3)] * 90
    df = spark.createDataFrame(rows, MANIFEST_DDL)
    got = merkle.manifest(df, tampered=merkle.lower_cased_thirds())
    want = naive_manifest([r.asDict() for r in df.collect()])
    out = got.collect()
    assert sorted(repr(tuple(r)[:5]) for r in out) == sorted(map(repr, want))
    changed = {repr(r["doc_id"]) for r in df.collect() if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and (r["text"] or "") != (r["text"] or "").lower()}
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in out)
    assert changed and {repr(r["doc_id"]) for r in out if not r["verified"]} == changed
    assert all(r["verified"] for r in merkle.manifest(df).collect())
    assert merkle.manifest(df.limit(0)).count() == 0
    alone = merkle.manifest(df.limit(1)).first()
    assert alone["leaf"] == alone["root"] == alone["subroot"] == alone["folded_root"] and alone["proof_sha256"] == H([])


@pytest.mark.parametrize("leaves", [4095, 4096, 4097, 4096 * 8 + 1])
def test_manifest_over_several_blocks(spark, leaves):
    df = spark.range(leaves, numPartitions=5).selectExpr("id AS doc_id", "'s' AS source", "'en' AS lang", "id AS n_chars", "concat('T', id) AS text")
    out = {r["doc_id"]: r for r in merkle.manifest(df).collect()}
    ids = [r["leaf"] for _, r in sorted(out.items())]
    root, proofs = naive_tree(ids)
    assert {r["root"] for r in out.values()} == {root} == {r["folded_root"] for r in out.values()}
    for i in random.Random(1).sample(range(leaves), 200) + [0, leaves - 1]:
        assert out[i]["proof_sha256"] == H(proofs[i])


def test_op11_equals_its_sql(spark, sf_dir):
    got, want = same_as_sql(structure_queries.op11_merkle(spark, sf_dir), structure_queries.OP11_SQL, "documents", f"'{sf_dir}/documents.parquet'")
    assert got == want


# Secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)


def plain_secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(s, secrets.KINDS[k], e) for s, k, e in sorted(found)]


def test_base_patterns_on_random_texts():
    rnd = random.Random(5)
    parts = ["token", "Token", "toKen", "ſecret", "PASSWORD", "passwd", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "  ", "abc", "abcdef", "AKIA", "ABCDEFGH", "A" * 12, "0123456789ab", "deadbeef", "é", "\n", ".", "-", "/", "x_y"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        assert secrets.base_spans(text) == plain_secrets(text)


def wrappers():
    b64 = lambda s: base64.b64encode(s.encode("latin-1")).decode()
    packed = lambda f: lambda s: base64.b64encode(f(s.encode("latin-1"))).decode()
    return {
        "url": lambda s: "".join(f"%{ord(c):02X}" for c in s),
        "u": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        "x": lambda s: "".join(f"\\x{ord(c):02x}" for c in s),
        "entity": lambda s: "".join(f"&#{ord(c)};" for c in s),
        "b64": b64,
        "b64url": lambda s: base64.urlsafe_b64encode(s.encode("latin-1")).decode().rstrip("="),
        "gzip": packed(gzip.compress),
        "zlib": packed(zlib.compress),
        "bz2": packed(bz2.compress),
    }


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_wrapped_secrets_are_found_where_they_stand(depth):
    rnd = random.Random(depth)
    unwrapper, ways = secrets.Unwrapper(1 << 30), wrappers()
    for _ in range(120):
        inner = f"password={''.join(rnd.choice('abcxyzQRS789') for _ in range(rnd.randint(8, 30)))}"
        hidden, used = inner, []
        for _ in range(depth):
            used.append(rnd.choice(list(ways)))
            hidden = ways[used[-1]](hidden)
        text = "é before " + hidden + " behind é"
        spans, unread = unwrapper.spans(text)
        s, e = 9, 9 + len(hidden)
        hits = [(a, b) for a, k, b, base, _ in spans if k == "assign" and not base]
        assert not unread and any(s <= a and b <= e and b - a >= (e - s) * 0.9 - 4 for a, b in hits), (used, text, spans)
        base = [(a, k, b) for a, k, b, is_base, _ in spans if is_base]
        assert base == plain_secrets(text)


def test_exact_places_in_a_layer():
    unwrapper = secrets.Unwrapper(1 << 30)
    whole = "some words token=abcdefgh and more words"
    coded = base64.b64encode(whole.encode()).decode()
    (span,) = [s for s in unwrapper.spans("<" + coded + ">")[0] if s[1] == "assign"]
    at = whole.index("token")
    assert span[:3] == (1 + at * 8 // 6, "assign", 1 + -(-(at + len("token=abcdefgh")) * 8 // 6))
    lines = "\n".join(base64.b64encode(("filler " * 20 + whole).encode()).decode()[i : i + 76] for i in range(0, 260, 76))
    assert any(k == "assign" for _, k, *_ in unwrapper.spans(lines)[0])
    assert unwrapper.spans("tok%25%36%35n=abcdefg")[0][0][:3] == (0, "assign", 21)


def test_deep_escapes_cycles_and_bombs():
    unwrapper = secrets.Unwrapper(1 << 20)
    deep = "token=abcdefg"
    for _ in range(50):
        deep = deep.replace("%", "%25") if "%" in deep else deep.replace("t", "%74").replace("=", "%3D")
    found, _ = unwrapper.spans(deep)
    assert [(s, e) for s, k, e, *_ in found if k == "assign"] == [(0, len(deep))]
    assert unwrapper.spans("%25" * 4000)[0] == []
    bomb = base64.b64encode(gzip.compress(b"0" * (1 << 24))).decode()
    found, unread = unwrapper.spans("a " + bomb)
    assert unread == 1
    found, unread = secrets.Unwrapper(1 << 30).spans("a " + bomb)
    assert unread == 0 and any(k == "hex" and (s, e) == (2, 2 + len(bomb.rstrip("="))) for s, k, e, *_ in found)


def test_secrets_of_odd_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "y"), (None, "token = 'abcdefghi'", None), (3, "t " * 200_000 + "AKIA" + "A" * 30, "z")]
    out = secrets.with_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string"))
    assert out.columns == ["doc_id", "text", "spans", "n_unread"]
    found = out.collect()
    assert len(found) == 5 and sum(len(r["spans"]) for r in found) == 2
    assert secrets.with_secrets(out.drop("n_unread").limit(0)).count() == 0


def test_op12(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = structure_queries.op12_secrets(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        base = plain_secrets(texts[r["doc_id"]])
        names = [f"{k}:{s}:{e}" for s, k, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == kind for _, k, _ in base) for kind in secrets.KINDS]
        assert set(names) <= set(r["spans"].split(",") if r["spans"] else [])


# Trie


def test_nearest_smaller_and_totals_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(smaller_values, "BLOCK", 12)
    rnd = random.Random(6)
    for n, top in ((0, 3), (1, 3), (160, 4), (60, 40)):
        values = [-1] + [rnd.randint(0, top) for _ in range(n - 1)] if n else []
        df = spark.createDataFrame([(i, i, v, 0) for i, v in enumerate(values)], "at long, pos long, value long, owner long")
        got = {r["pos"]: (r["left"], r["right"]) for r in smaller_values.nearest_smaller(df, Passes(spark, "t")).collect()}
        for i, v in enumerate(values):
            left = next((j for j in range(i - 1, -1, -1) if values[j] < v), None)
            right = next((j for j in range(i + 1, n) if values[j] < v), None)
            assert got.pop(i) == (left, right)
        assert not got
        asked = {tuple(sorted(rnd.sample(range(n + 1), 2))) for _ in range(30)} if n else set()
        items = spark.createDataFrame([(i, v * 3, -v) for i, v in enumerate(values)], "pos long, w long, low long")
        out = smaller_values.stretch_totals(items, spark.createDataFrame(sorted(asked), "lo long, hi long"), ["w"], "low", Passes(spark, "t")).collect()
        assert sorted(map(tuple, out)) == sorted((a, b, sum(3 * v for v in values[a:b]), min(-v for v in values[a:b])) for a, b in asked)


TURNS = "conv_id long, turn long, role string, text string, turns int, pos int"


@pytest.mark.parametrize("block", [24, 4096])
def test_trie_of_odd_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(smaller_values, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "_IDS_AT_ONCE", 2)
    rnd = random.Random(block)
    rows = [(rnd.choice([c, c, c, c, -c]), rnd.choice([None, 0, 1, t, t]), rnd.choice([None, "", "user", "a"]), rnd.choice([None, "", "é", "x", "yy"]), 1, 2) for c in range(60) for t in range(rnd.randint(1, 6))]
    rows += [(1000 + i, t, "u", "copy", 1, 2) for i in range(40) for t in range(5)] + [(2000 + 5 * i, t, "u", "copy", 1, 2) for i in range(9) for t in range(i)]
    rows += [(None, 1, "u", "no conversation", 1, 2)] * 3
    df = spark.createDataFrame(rows, TURNS)
    got, want = same_as_sql(prefix_trie.trie(prefix_trie.rebuilt(df)), structure_queries.OP13_SQL, "conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert got == want and len(got) > 60


def test_no_conversation_and_one(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie(prefix_trie.rebuilt(none)).count() == 0
    one = spark.createDataFrame([(0, 0, "u", "abc", 1, 1), (0, 1, "u", "de", 1, 1)], TURNS)
    out = sorted(prefix_trie.trie(prefix_trie.rebuilt(one)).collect(), key=lambda r: r["depth"])
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in out] == [(0, 0, None, 1, 1, 1, 0, empty), (0, 1, 0, 1, 1, 1, 0, empty), (0, 2, 0, 1, 0, 1, 0, hashlib.sha256(b"0").hexdigest())]
    turnless = spark.createDataFrame([(7, [])], "conv_id long, turns array<struct<token:binary,bytes:int>>")
    assert [tuple(r) for r in prefix_trie.trie(turnless).collect()] == [(7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())]


def test_op13_equals_its_sql(spark, sf_dir):
    got, want = same_as_sql(structure_queries.op13_trie(spark, sf_dir), structure_queries.OP13_SQL, "conversations", f"'{sf_dir}/conversations.parquet'")
    assert got == want
