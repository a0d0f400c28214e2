"""The stages on a small corpus with planted cases, and each against the operator's own rule."""
import random
import re

import pytest

import corpus_pipeline
from storyline.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(21)
    syllables = ["re", "the", "on", "ing", "au", "st", "und", "lo", "er", "a"]

    def text(n):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))

    folder = str(tmp_path_factory.mktemp("tables"))
    rows, labels = [], []
    items = [text(n) for n in (20, 30, 45)]
    passage = text(60)
    for i in range(240):
        body = text(rng.randint(20, 120))
        if i % 8 == 0:      # toxic
            body += " grumblor you " + text(3) + " snorvel " + text(4) + " grumblor"
        labels.append((i, 1, int(i % 8 == 0)))
        rows.append((i, body))
    base = text(150)
    rows += [(300, base), (301, base), (302, base.replace(" ", "\n", 3)), (303, base + " more")]
    rows += [(310 + i, text(40) + " " + passage + " " + text(30)) for i in range(4)]
    rows += [(320 + i, text(40) + " " + items[i] + " " + text(30)) for i in range(3)]
    rows += [(330, ""), (331, None), (332, "x"), (333, "grumblor snorvel grumblor, " + text(20))]
    docs = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in rows]
    for name, data, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
                               ("labels", labels, "doc_id long, quality int, toxic int"),
                               ("pages", [(i, f"http://h{i % 3}.example/{i}", f"<nav>menu</nav><article><p>{text(9)}</article>") for i in range(20)],
                                "page_id long, url string, html string"),
                               ("conversations", [(i // 3, i % 3, "user", text(4)) for i in range(60)],
                                "conv_id long, turn long, role string, text string"),
                               ("benchmark", list(enumerate(items)), "item_id long, text string")):
        spark.createDataFrame(data, schema).repartition(2).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]
    texts = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema.names == docs.schema.names and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), out.schema)
        texts.append({r.doc_id: r.text for r in docs.collect()})
        assert docs.count() == len(texts[-1])
    clean, unique, cut, free = texts[1:]
    # toxic documents go, clean ones stay, empty ones too
    assert not [i for i in range(0, 240, 8) if i in clean] and 333 not in clean
    assert all(i in clean for i in range(240) if i % 8) and {330, 331, 332} <= set(clean)
    # one of the near copies stays, and nothing else goes
    assert set(clean) - set(unique) == {301, 302, 303}
    # the shared passage goes from all that have it, the rest of their words stays
    for i in range(310, 314):
        assert len(WORD.findall(cut[i])) <= 75 and cut[i][:100] == unique[i][:100]
    assert {i for i in unique if unique[i] != cut.get(i)} == {310, 311, 312, 313}
    assert set(cut) - set(free) == {320, 321, 322}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    lengths = {}
    for r in packed:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {i: len(WORD.findall(t or "")) + 1 for i, t in free.items()}


def test_run_is_all_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    ids = {r.doc_id for r in rows}
    assert not ids & {0, 8, 301, 302, 303, 320, 321, 322, 333} and {1, 300, 310, 330, 331} <= ids


COLUMNS = {
    "op1_decontamination": {"doc_id", "item_id", "similarity"},
    "op2_suffix_array": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op3_super_kmers": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op4_token_ids": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op5_quality": {"doc_id", "perplexity", "keep"},
    "op6_language_model": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op7_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op8_best_fit": {"doc_id", "sequence_id", "position", "length"},
    "op9_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op10_jaccard_join": {"doc_id", "n_shingles", "component_id"},
    "op11_site_trees": {"page_id", "url", "text", "n_chars"},
    "op12_collocations": {"lang", "rank", "phrase", "a", "l", "r", "n", "score"},
    "op13_prefix_trie": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_queries_have_their_columns(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir)
    assert COLUMNS[name] <= set(rows.columns)
    others = {"op1_decontamination", "op5_quality", "op8_best_fit", "op12_collocations", "op13_prefix_trie"}
    if name not in others:
        source = "pages" if name == "op11_site_trees" else "documents"
        assert rows.count() == spark.read.parquet(f"{sf_dir}/{source}.parquet").count()


def test_all_operators():
    assert set(QUERIES) == set(COLUMNS)
