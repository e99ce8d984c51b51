import re
from collections import Counter

import pytest

from txflow.llm import lines
from txflow.llm.queries import OP10_SQL, op10_line_rules
from tests.compare import compare, connect


def brute(rows, min_docs, max_share):
    clean = lambda x: re.sub(r"[ \t\v\f\r]+", " ", x).lower().strip(" ")
    held, size = Counter(), Counter(r.source for r in rows)
    for r in rows:
        held.update({(r.source, clean(x)) for x in (r.text or "").split("\n") if clean(x)})
    out = []
    for r in rows:
        t = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = {w for w, n in Counter(windows).items() if n > 1}
        covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
        worded = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        own = [clean(x) for x in t.split("\n") if clean(x)]
        gone = [x for x in own if held[r.source, x] > max(min_docs, max_share * size[r.source])]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        out.append((r.doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(worded) - len(set(worded)), len(covered), failed,
                    not failed and sum(map(len, gone)) <= 0.5 * sum(map(len, own)), len(own), len(gone)))
    return Counter(out)


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_removed_lines")


@pytest.mark.parametrize("limits", [(20, 0.01), (1, 0.0)])
def test_against_brute_force(odd, limits):
    got = lines.judge(odd, min_docs=limits[0], max_share=limits[1]).select(*COLUMNS).collect()
    assert Counter(map(tuple, got)) == brute(odd.collect(), *limits)


def boilerplate(spark):
    body = lambda i: " ".join(f"word{i}x{k}" for k in range(60))
    rows = [(i, f"{body(i)}\n  All Rights\tReserved \n{body(i + 1000)}", "a") for i in range(40)]
    rows += [(100 + i, f"{body(7)}{i}\n" + "\n".join(["all rights reserved"] * 90), "a") for i in range(3)]
    rows += [(200, f"{body(5000)}\nall rights reserved", "b"), (201, f"{body(5001)}\nall rights reserved", None)]
    rows += [(300 + i, f"{body(9000)}\ncopied line", "a") for i in range(50)]  # documents like others: above the limit
    rows += [(400 + i, f"{body(9500)}\nfew copies", "a") for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_frequent_lines_go_and_depleted_documents_too(spark):
    df = boilerplate(spark)
    judged = {r.doc_id: r for r in lines.judge(df).collect()}
    assert all(judged[i].n_removed_lines == 1 and judged[i].kept for i in range(40))
    assert all(judged[i].n_removed_lines == 90 and not judged[i].kept for i in (100, 101, 102))
    assert all(judged[i].n_removed_lines == 0 and judged[i].kept for i in (200, 201, 400, 419))  # other hosts, few copies
    assert all(judged[i].n_removed_lines == 2 and not judged[i].kept for i in (300, 349))
    cleaned = {r.doc_id: r.text for r in lines.clean(df).collect()}
    assert "Rights" not in cleaned[0] and len(cleaned[0].split("\n")) == 2 and 100 not in cleaned and "reserved" in cleaned[200]


def test_no_python_in_the_plan(odd):
    plan = lines.judge(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_clean_keeps_columns(odd, empty):
    assert lines.clean(odd).columns == odd.columns
    assert lines.judge(empty).collect() == [] and lines.clean(empty).collect() == []


def test_matches_sql(spark, sf):
    assert compare(spark, connect(sf), sf, op10_line_rules, OP10_SQL) == "ok"
