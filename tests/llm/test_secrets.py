import re

from doclattice.llm.secrets import scan_secrets

KINDS = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
TEXT = """a PASSWORD = 'hunter2x' secret=token:abcdefgh token=abc password==abcde
é AKIA""" + "A" * 16 + " AKIASHORT " + "0a" * 12 + " api_key:" + "f" * 30 + " \U0001f600 apikey=zzzzzz"


def brute(text):
    found = []
    for no, (kind, pattern, group, least) in enumerate(KINDS):
        for m in re.finditer(pattern, text or "", re.I if kind == "assign" else 0):
            if len(m[group]) >= least:
                found.append((m.start(), no, m.end(), kind))
    return sorted(found)


def test_spans_and_ownership(spark):
    rows = [(i, TEXT, f"s{i % 3}") for i in range(4)] + [(9, "token=Qw3rTy9Uiop", "s9"), (10, None, None), (11, "", "x")]
    got = {r["doc_id"]: r for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for i, text, _ in rows:
        assert [(s["start"], s["kind_no"], s["stop"], s["kind"]) for s in got[i]["spans"]] == brute(text)
    assert got[9]["n_live"] == 1 and got[9]["n_example"] == 0
    assert got[0]["n_example"] == len(brute(TEXT)) and got[0]["max_owners"] == 3
    assert got[10]["spans"] == [] and got[10]["max_repos"] == 0


def test_odd(spark, odd, none):
    assert scan_secrets(odd).count() == odd.count()
    assert scan_secrets(none).count() == 0
