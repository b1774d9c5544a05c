import re

import __spark_entry__ as E


def test_entry_runs_with_stable_schema(spark):
    a = E.entry(spark)
    b = E.entry(spark)
    assert a.schema == b.schema
    assert a.count() > 0


def test_every_oracle_has_a_query():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 100


def test_query_names_follow_survey_ids():
    for name in E.queries():
        if E.llm and (name == "pipeline" or re.match(r"^op\d+_", name)):
            continue
        assert re.match(r"^[a-z]\d+_[a-z0-9_]+$", name), name


def test_entry_without_the_training_data_part():
    """The entry imports, with every other query, when that part is not there."""
    import subprocess
    import sys
    code = ("import sys; sys.modules['corpus_pipeline'] = None; sys.modules['tally.llm'] = None; "
            "import __spark_entry__ as E; q = E.queries(); assert len(q) >= 100 and 'pipeline' not in q, q; "
            "assert not any(n.startswith('op') for n in q); assert set(E.oracle_sql()) <= set(q)")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=E.__file__.rsplit("/", 1)[0])
