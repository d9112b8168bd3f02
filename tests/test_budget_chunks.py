import random

from maskwell.plans import catalogue


def chunks(costs, budget=510, overlap=30):
    out, first = [], 0
    while first < len(costs):
        end, total = first, 0
        while end < len(costs) and total + costs[end] <= budget:
            total += costs[end]
            end += 1
        end = max(end, first + 1)
        out.append((first, end))
        first = len(costs) if end >= len(costs) else max(first + 1, end - overlap)
    return out


def test_documents_are_cut_by_the_budget_of_the_model(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join("x" * rng.randint(1, 12) for _ in range(n)) for n in (0, 1, 400, 3_000, 20_000)] + ["y" * 3_000 + " z" * 600, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in catalogue.queries()["budget_chunks_of_documents"](spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append((r["first"], r["end"]))
    for k, text in enumerate(texts):
        assert sorted(got.get(k, [])) == chunks([-(-len(w) // 4) for w in (text or "").split()]), k
