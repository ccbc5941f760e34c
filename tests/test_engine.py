import pytest
from pyspark.sql import functions as F

from tessera.engine import KnowledgeBase

DOCS = {
    "raw/a.md": "# Finance\n## Debt\nACME revenue was 32 in the year. See [[b]].\n\nACME cost was 18.",
    "raw/b.md": "# Plans\nzebra42 plan of revenue growth",
    "raw/secret.md": "---\nacl: [board]\n---\n# Pay\nrevenue share of salaries 500",
    "raw/old.md": "---\nstate: superseded\n---\n# Old\nrevenue was 1",
    "wiki/s.md": "---\nsource: raw/secret.md\n---\n# Copy\nrevenue restated",
    "wiki/t.md": "---\nttl: 1d\nvalid_from: 2020-01-01\n---\n# T\n- growth without a source\n\nas [[a.md#Finance/Debt/1]] says",
}


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    for name, text in DOCS.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    return KnowledgeBase.from_folders(spark, str(root / "raw"), str(root / "wiki"))


def ids(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_search_respects_access_and_state(base):
    anonymous = ids(base.search("revenue"))
    assert "a.md#Finance/Debt/0" in anonymous and not {"secret.md#Pay/0", "s.md#Copy/0", "old.md#Old/0"} & set(anonymous)
    board = ids(base.search("revenue", groups=["board"]))
    assert {"secret.md#Pay/0", "s.md#Copy/0"} <= set(board) and board.index("secret.md#Pay/0") < board.index("s.md#Copy/0")
    assert "old.md#Old/0" in ids(base.search("revenue", include_states=("superseded",)))
    assert all(r.layer == "raw" for r in base.search("revenue", groups=["board"], layer="raw").collect())


@pytest.mark.parametrize("channel", ["lexical", "graph", "tree", "full"])
def test_channels(base, channel):
    assert "b.md#Plans/0" in ids(base.search("zebra42 Plans", channel=channel))


def test_ask_and_refuse(base):
    got = base.ask("ACME revenue").first()
    assert got.verdict == "enough" and got.n_evidence > 0 and "[[a.md#Finance/Debt/0]]" in got.answer
    assert base.ask("qqxx").first().verdict == "evidence_absent"
    assert base.ask("ACME revenue", generate=lambda q, c: "no citation").first().violations == ["citation 0/1 sentences cited"]


def test_retraction_and_lint(base):
    after = base.retracted(["a.md#Finance/Debt/1"])
    assert "a.md#Finance/Debt/1" not in ids(after.search("ACME cost"))
    assert [r.doc_path for r in after.pages.filter("stale").collect()] == ["t.md"]
    kinds = {(r.kind, r.subject) for r in after.lint(F.lit("2024-01-01").cast("date")).collect()}
    assert {("expired", "t.md"), ("stale", "t.md"), ("orphan", "s.md")} <= kinds and any(k == "unsourced" for k, _ in kinds)
    assert {r.verdict for r in base.claim("revenue 32", ["a.md#Finance/Debt/0"]).collect()} == {"entailed"}
    assert base.changes(base).count() == 0
    assert {"sources/a.md.md", "entities/acme.md"} <= {r.path for r in base.derived_pages().collect()}


def test_stored_index_finds_what_the_scan_finds(base):
    kb = base.indexed()
    for q in ("revenue", "ACME cost", "zebra42 nowhere", "", "..."):
        assert [tuple(r) for r in kb.channel("lexical", q, 5).orderBy("rank").collect()] == [tuple(r) for r in base.channel("lexical", q, 5).orderBy("rank").collect()]
    assert ids(kb.search("revenue", groups=["board"])) == ids(base.search("revenue", groups=["board"]))
    kb.index.drop()
