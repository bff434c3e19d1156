"""The pipeline's stages one after another, each against what it must do to its own input."""

import re

import pytest

import corpus_pipeline
from xylem.llm import queries as llm_queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    """The input of each stage and the output of the last, written and read again as a driver would."""
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(str(base / str(k)))
        out.append(spark.read.parquet(str(base / str(k))))
    return out


def test_stages_keep_columns(outputs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "ngram_jaccard_join", "suffix_array_dedup", "secret_scans", "best_fit_packing"]
    for df in outputs[:-1]:
        assert sorted(df.columns) == sorted(COLUMNS)


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_keeps_clean_documents(spark, outputs):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = rows(outputs[1])
    clean = [i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)
    assert all(kept[i] == r for i, r in rows(outputs[0]).items() if i in kept)


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_one_of_each_group_stays(outputs):
    before, after = rows(outputs[1]), rows(outputs[2])
    sets = {i: shingles(r["text"]) for i, r in before.items()}
    near = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and near(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert set(after) == {i for i in sets if root(i) == i}


def test_repeated_doc_ids(spark):
    a, b, c = ("".join(f"{w}{k} " for k in range(30)) for w in "abc")
    docs = spark.createDataFrame([(5, a, "en", "s", 1), (5, a, "en", "s", 1), (5, a, "de", "s", 1), (7, a, "en", "s", 1), (7, b, "en", "s", 1), (9, b, "en", "s", 1), (None, c, "en", "s", 1), (None, a, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(((r["doc_id"] or 0, r["text"], r["lang"]) for r in got)) == [(0, c, "en"), (5, a, "de"), (7, b, "en")]


def test_repeated_strings_go(outputs):
    before, after = rows(outputs[2]), rows(outputs[3])
    assert set(before) == set(after)
    seen: set[bytes] = set()
    for i in sorted(before):
        b, new, gone = (before[i]["text"] or "").encode(), set(), set()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            if w in seen:
                gone.update(range(k, k + 50))
            else:
                new.add(w)
        seen |= new
        left = bytes(x for k, x in enumerate(b) if k not in gone).decode("utf-8", "ignore")
        assert after[i]["text"] == left and after[i]["lang"] == before[i]["lang"]
        assert after[i]["n_chars"] == (len(left) if gone else before[i]["n_chars"])


def test_secrets_are_replaced(outputs):
    before, after = rows(outputs[3]), rows(outputs[4])
    assert set(before) == set(after)
    pattern = re.compile(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}")
    for i, r in before.items():
        found = pattern.search(r["text"] or "")
        assert not pattern.search(after[i]["text"] or "")
        if after[i]["text"] == r["text"]:
            assert not found


def test_sequences(outputs):
    places = {}
    for r in outputs[5].collect():
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert {r["doc_id"] for r in outputs[5].select("doc_id").collect()} == set(rows(outputs[4]))


def test_every_operator_has_its_query():
    names = llm_queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(llm_queries.oracle_sql()) <= set(names)
