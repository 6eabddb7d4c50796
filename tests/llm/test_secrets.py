import hashlib

from cohortline.llm.secrets import MASK, scan_secrets
from tests.llm.fixtures import documents, none


def planted(n=40):
    rows = []
    for i in range(n):
        digest = hashlib.sha1(str(i).encode()).hexdigest()
        aws = "AKIA" + hashlib.sha1(b"k%d" % i).hexdigest().upper()[:16]
        rows.append((i, f'the value of token = "{digest}" and the rest of it', [digest]))
        rows.append((100 + i, f"here is {aws} among words and {aws} again", [aws]))
        rows.append((200 + i, f"login password={digest[:18]} from the site, thentionhationereding{'ab' * (i % 4)} is a word", [digest[:18]]))
        rows.append((300 + i, "plain words of the textandofthewordinthe others " * 2 + f"{digest[:8]}-{digest[8:12]}-4{digest[13:16]}-a{digest[17:20]}-{digest[20:32]}", []))
    return rows


def test_planted_findings(spark):
    rows = planted()
    out = scan_secrets(spark.createDataFrame([(i, t, "a/b.txt", "x") for i, t, _ in rows], "doc_id long, text string, source string, secrets string"))
    found = {r.doc_id: r for r in out.select("row.doc_id", "row.text", "n_candidates", "secrets").collect()}
    for i, text, secrets in rows:
        assert {s.secret for s in found[i].secrets} == set(secrets), text
        for s in secrets:
            text = text.replace(s, MASK)
        assert found[i].text == text
        assert all(text.split()[s.at] for s in found[i].secrets)


def test_odd_rows_and_no_labels(spark):
    docs, rows = documents(spark)
    out = scan_secrets(docs)
    assert out.select("row.*").columns == docs.columns
    texts = sorted((r.text or "" for r in out.select("row.text", "secrets").collect() if not r.secrets))
    assert len(texts) <= len(rows) == out.count()
    assert scan_secrets(none(spark)).count() == 0
    nulls = spark.createDataFrame([(1, None, None), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.row.text, r.n_candidates, r.secrets) for r in scan_secrets(nulls).orderBy("row.doc_id").collect()] == [(None, 0, []), ("", 0, [])]


def test_no_python_in_the_plan(spark):
    plan = scan_secrets(spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
