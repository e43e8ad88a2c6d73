import pytest

from marketloom.session import get_session

#: Null ids, null, empty and blank texts, one very long text, repeated rows, exact and near copies, and columns whose names clash with the operators' own.
LONG = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
BASE = " ".join(f"alpha{k}" for k in range(60))
NEAR = BASE.replace("alpha59", "omega")
ROWS = [
    (1, BASE, "en"), (2, None, "en"), (3, "", None), (4, " \n\t ", "en"), (5, LONG, "en"), (6, BASE, "fr"), (7, NEAR, "en"), (8, "one two", "en"), (9, "one two", "en"),
    (None, BASE, "en"), (None, None, None), (10, "same row here", "en"), (10, "same row here", "en"), (11, "intro words " + BASE + " closing words", "en"),
    (12, "mail a.b@c.org or +1 (988) 555-2485 <|endoftext|> x", "en"), (13, "Ünïcödé ＠ 日本語 テスト \x1c odd space", "de"),
]


@pytest.fixture(scope="session")
def spark():
    session = get_session("llm-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(a, b, c, "s", 7, 1.0, "t", 3) for a, b, c in ROWS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept string, n_tokens int").repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")
