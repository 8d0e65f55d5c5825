"""The queries over the real rule sets: every code occurs in some row."""

from sievework.operators import rules
from sievework.plans import bindings, editorial  # noqa: F401

MIDDLE = "/root/testdata/sf0.01"


def codes_in(con, name, *columns):
    found = con.sql(bindings.ORACLES[name])
    at = [found.columns.index(c) for c in columns]
    return {code for row in found.fetchall() for i in at for code in (row[i] or "").split(",")} - {""}


def test_every_code_occurs(spark):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{MIDDLE}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    named = lambda rs: {r.code for r in rs}
    assert codes_in(con, "import_review", "errors", "warnings") == named(rules.import_rules())
    assert codes_in(con, "batch_issues", "code") == named(rules.batch_rules("e1", "manual"))
    assert codes_in(con, "save_checks", "codes") == named(rules.save_rules())
    assert codes_in(con, "verifier_checks", "codes") >= named(rules.verifier_rules())
    messages = {m for _, _, m, _ in editorial.DIAGNOSTICS}
    assert {r.message for r in rules.diagnostic_rules()} == messages
    found = con.sql(bindings.ORACLES["diagnostics"])
    at = found.columns.index("diagnostic_id")
    ids = {row[at] for row in found.fetchall()}
    assert all(any(i.endswith(m.lower().replace(" ", "-")) for i in ids) for m in messages)
