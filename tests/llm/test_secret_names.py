import pytest

from filigraph.llm import secrets
from tests.llm.test_scans import KEY

LONG = ('AWS_SECRET_ACCESS_KEY = "{}"', "github_oauth_token: {}", 'client_secret_value="{}"', "stripe_webhook_signing_secret={}")


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(secrets.synthetic_findings(spark))


def test_before_and_after_are_of_the_whole_text(spark):
    text = f'é AWS_SECRET_ACCESS_KEY = "{KEY}"; {"a" * 16} {"b" * 16}= {"c" * 16}+{"d" * 20} z'
    rows = secrets.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(rows) == 5
    for r in rows:
        at, end = r["start"] - 1, r["start"] - 1 + len(r["candidate"])
        assert text[at:end] == r["candidate"] and r["before"] == text[max(0, at - 48) : at] and r["after"] == text[end : end + 24]


def test_values_of_long_names_are_found(spark, model):
    values = (KEY, "9f86d081884c7d659a2feaa0c55ad015", "Zk3vQ9xT1mLr8WcY5bNd2HgJ")
    docs = [(10 * i + k, "some words here " + name.format(v) + " and more") for i, name in enumerate(LONG) for k, v in enumerate(values)]
    found = {(r["doc_id"], r["length"]) for r in secrets.scan(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert found == {(10 * i + k, len(v)) for i in range(len(LONG)) for k, v in enumerate(values)}


def test_digests_of_long_names_are_not(spark, model):
    docs = spark.createDataFrame([(1, f"artifact_sha256_checksum: {KEY}"), (2, f'see release_commit_digest = "{KEY}"')], "doc_id long, text string")
    assert secrets.scan(docs, model).count() == 0
