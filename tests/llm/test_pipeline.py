"""The stages of corpus_pipeline decide by row: rows with a null id and rows that share one."""

import hashlib
import random

import corpus_pipeline
import pytest

from quarrymill.llm import decontaminate

ITEM = "what is the name of the river that runs through the old harbour of the northern town"


def prose(seed):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ale", "orn", "ist", "ump")]
    line = lambda: " ".join(r.choice(words) for _ in range(9)).capitalize() + " and the end."
    return "\n".join(line() for _ in range(12))


@pytest.fixture(scope="module")
def docs(spark):
    a, b, c, e, f = map(prose, range(5))
    near = a.replace(a.split()[40], "changed", 1)
    rows = [(None, a), (3, near), (4, a), (4, a), (5, b), (5, "no"), (None, "no"), (None, c), (None, c), (6, e), (6, f"{f}\n{ITEM}"), (None, f"{prose(9)}\n{ITEM}"), (7, None), (8, "")]
    return spark.createDataFrame([(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")


def places(df):
    return sorted(int(r.source[1:]) for r in df.collect())


def test_quality_rules_judge_rows(spark, docs):
    assert places(corpus_pipeline.quality_rules(spark, docs, "")) == [0, 1, 2, 3, 4, 7, 8, 9, 10, 11]


def test_one_row_of_each_component_stays(spark, docs):
    got = places(corpus_pipeline.near_duplicates(spark, docs, ""))
    assert len({7, 8} & set(got)) == 1 and [k for k in got if k not in (7, 8)] == [1, 4, 5, 9, 10, 11, 12, 13]
    assert corpus_pipeline.near_duplicates(spark, docs, "").columns == docs.columns


def test_rows_that_hold_an_item_go(spark, docs):
    benchmark = spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string")
    assert places(decontaminate.clean(docs, benchmark)) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 13]
    assert decontaminate.clean(docs, benchmark.limit(0)).count() == 14


def test_found_items_equal_plain_search(spark, docs):
    texts = {k: r.text for k, r in enumerate(docs.collect())}
    numbered = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    items = {1: ITEM, 2: "changed", 3: "no", 4: "And THE  end."}
    benchmark = spark.createDataFrame([*items.items(), (5, ""), (6, None), (1, ITEM)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance) for r in decontaminate.find_items(numbered, benchmark).collect())
    plain = lambda t: " ".join((t or "").lower().split())
    assert got == sorted((k, i, 0) for k, t in texts.items() for i, x in items.items() if plain(x) in plain(t))
    hit = {k for k, _, _ in got}
    clean = {r.doc_id for r in decontaminate.clean(numbered, benchmark).collect()}
    assert clean == set(texts) - hit


def test_run_equals_its_stages_by_hand(spark, tmp_path):
    """What run() packs are the pieces of exactly the rows that should stay, with personal data replaced."""
    good = [prose(k) for k in range(20, 26)]
    mail = f"{good[4]}\nWrite to jane.doe@example.org and the end."
    rows = [(1, good[0]), (2, good[0]), (3, f"{good[1]}\n{ITEM}"), (4, "no"), (None, good[2]), (6, None), (7, ""), (8, mail), (9, good[3]), (9, good[5])]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stay = [(1, good[0]), (None, good[2]), (8, mail.replace("jane.doe@example.org", "[EMAIL]")), (9, good[3]), (9, good[5])]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.cut(stage(spark, docs, str(tmp_path)), name.replace(" ", "-"))
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in docs.collect()), key=repr) == sorted(((i, t, len(t)) for i, t in stay), key=repr)
    want = corpus_pipeline.packing.pack(spark.createDataFrame(stay, "doc_id long, text string"))
    by_piece = lambda df: sorted(((r.doc_id, r.length) for r in df.collect()), key=repr)
    assert by_piece(corpus_pipeline.run(spark, str(tmp_path))) == by_piece(want)


def test_pii_query_columns(spark, tmp_path):
    from quarrymill.llm import pii

    spark.createDataFrame([(1, "to a.b@c.de now"), (2, None), (3, "none")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = sorted(tuple(r) for r in pii.op1_pii(spark, str(tmp_path)).collect())
    assert got == [(k, int(k == 1), 0, 0, 0, digest(x), x) for k, x in ((1, "email:3:11"), (2, ""), (3, ""))]


def test_account_numbers_are_redacted_whole(spark):
    texts = {"iban NL91 ABNA 0417 1643 00 now": "iban [ACCOUNT] now", "IBAN: GB29 NWBK 6016 1331 9268 19, then": "IBAN: [ACCOUNT], then", "iban NL92 ABNA x": "iban NL92 ABNA x"}
    long = "-".join("123456789012345678901234567890")
    texts |= {f"iban {long}.": "iban [ACCOUNT].", "iban DE44 5001 0517 5407 now": "iban [ACCOUNT] now"}
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    from quarrymill.llm import pii

    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == list(texts.values())
