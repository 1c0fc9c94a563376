import hashlib
import math
import random
from pathlib import Path

from millrace.llm import line_templates as lt
from millrace.llm.common import shared_dir


def brute(rows):
    """Kept text of each row, by the operator's rules, in plain Python."""
    lines = []  # (doc, row, pos, leaf, form)
    for r, (key, text) in enumerate(rows):
        for pos, line in enumerate([] if text is None else text.split("\n")):
            tokens = [lt.VARIABLE if any(c in "0123456789" for c in t) else t for t in line.replace("\t", " ").split(" ") if t]
            if tokens:
                lines.append((-1e99 if key is None else key, r, pos, (len(tokens), *tokens[: lt.DEPTH]), " ".join(tokens)))
    leaves = {}
    for doc, _, _, leaf, form in lines:
        leaves.setdefault(leaf, {}).setdefault(form, []).append(doc)
    first = {}
    for leaf, forms in leaves.items():
        rank = {f: (-len(docs), hashlib.md5(f.encode()).hexdigest(), f) for f, docs in forms.items()}
        differ = leaf[0] - math.ceil(leaf[0] * lt.AGREEMENT)
        cuts = [i * (leaf[0] - lt.DEPTH) // (differ + 1) + lt.DEPTH for i in range(differ + 2)]
        parts = {f: {(i, tuple(f.split(" ")[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))} if differ and leaf[0] > lt.DEPTH else set() for f in forms}
        up = {}
        for f in forms:
            leaders = {min((g for g in forms if p in parts[g]), key=rank.get) for p in parts[f]}
            alike = [g for g in leaders if sum(a == b for a, b in zip(f.split(" "), g.split(" "), strict=True)) >= lt.AGREEMENT * leaf[0]]
            up[f] = min([*alike, f], key=rank.get)
        shared = dict(up)
        for _ in forms:
            shared = {f: up[t] for f, t in shared.items()}
        for f, t in shared.items():
            first[leaf, f] = min(min(forms[g]) for g in forms if shared[g] == t)
    gone = {(r, pos) for doc, r, pos, leaf, form in lines if doc > first[leaf, form]}
    return [None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (r, p) not in gone) for r, (_, t) in enumerate(rows)]


def test_against_brute_force(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    long = " ".join(words * 6)
    rows = [(i, f"own line {words[i % 10]} {words[i // 10]} here\n{long}\nPage {i} of 30\n\n{long.replace('zeta', words[i % 3], 1)}") for i in range(40)]
    rows += [(7, None), (200, ""), (201, "\n \n"), (202, "own line"), (202, "own line"), (203, "own line\nown line"), (None, "own line\nnull id"), (3, "x " * 5000), (300, "x " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS pos", "'v' AS version")
    got = lt.drop_repeated(docs)
    assert got.columns == ["doc_id", "text", "pos", "version", "n_lines", "n_dropped"]
    want = brute(rows)
    show = lambda pairs: sorted((str(k), str(t)) for k, t in pairs)
    assert show((r.doc_id, r.text) for r in got.collect()) == show((k, w) for (k, _), w in zip(rows, want, strict=True))
    counts = {r.doc_id: (r.n_lines, r.n_dropped) for r in got.collect()}
    assert counts[0] == (4, 0) and counts[5][1] == 3 and counts[200] == (0, 0) and counts[202] == (1, 1)
    assert lt.drop_repeated(docs.where("false")).collect() == []


def test_several_templates_a_leaf(spark):
    rows = [(i, f"one two three four five six seven {n} nine ten") for i, n in enumerate(["a", "b", "c", "d", "e", "f"])]
    rows += [(10 + i, f"one two three four 5th sixth seventh {n} ninth tenth") for i, n in enumerate(["a", "b", "c", "d", "e", "f"])]
    rows += [(20 + i, f"one two three four words that {n} {n}{n} not {n}agree") for i, n in enumerate("uvwxyz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 AS n_lines", "'d' AS doc", "'r' AS row", "'l' AS lines", "'x' AS drop", "0 AS masked")
    got = {r.doc_id: r.n_dropped for r in lt.drop_repeated(docs).collect()}
    assert {k for k, n in got.items() if n} == {*range(1, 6), *range(11, 16)}
    assert lt.drop_repeated(docs).columns == ["doc_id", "text", "doc", "row", "lines", "drop", "masked", "n_lines", "n_dropped"]


def test_hot_leaf_against_brute_force(spark):
    r = random.Random(3)
    words = ["red", "blue", "green"]
    rows = [(i, "\n".join("head of the line " + " ".join(r.choice(words) for _ in range(r.choice([1, 6, 11]))) for _ in range(6))) for i in range(200)]
    got = lt.drop_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == {k: t for (k, _), t in zip(rows, brute(rows), strict=True)}


def test_sql_agrees(spark, tmp_path):
    import duckdb

    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, f"a b c d {i % 5} f\nshared words in every text\n\tdoc {chr(97 + i % 7)}\n") for i in range(30)] + [(31, None), (32, "")], "doc_id long, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(con.execute(lt.ORACLE_SQL).fetchall())
    got = lt.drop_repeated(spark.read.parquet(path)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, None if r.text is None else hashlib.sha256(r.text.encode()).hexdigest()) for r in got) == want


def test_temporaries_go(spark):
    """Of what a run writes only the places of the dropped lines stay."""
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    docs = spark.createDataFrame([(i, "one line of all\nand line %d of it" % i) for i in range(9)], "doc_id long, text string")
    found = lt.drop_repeated(docs)
    assert found.count() == 9 and found.where("n_dropped = 2").count() == 8 and len(set(shared.iterdir()) - before) == 1
