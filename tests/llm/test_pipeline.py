import os
import subprocess
import sys

import corpus_pipeline
from silvaflow.llm import bpe, exact_dedup, near_dedup, quality_rules

SF = "/root/testdata/sf0.001"


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    good = {r.doc_id for r in quality_rules.judged(quality_rules.statistics(docs)).collect() if r.kept}
    after = docs.filter(docs.doc_id.isin(sorted(good)))
    one = {r.doc_id for r in exact_dedup.exact_groups(after).collect() if r.kept}
    near = {r.doc_id for r in near_dedup.near_classes(after.filter(docs.doc_id.isin(sorted(one)))).collect() if r.kept}
    assert set(out) <= near <= one <= good and len(out) > 0.8 * len(near)
    import public_tokenizers

    texts = {r.doc_id: r.text for r in docs.collect()}
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert all(len(bpe.encode_texts([texts[i]], path)[0]) == 4 * r.n_tokens for i, r in list(out.items())[:20])


def test_entry_without_this_subpackage(tmp_path):
    repo = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    subprocess.run(["cp", "-r", f"{repo}/silvaflow", f"{repo}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/silvaflow/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'forest_nodes_depth3' in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
