"""Classification and extraction of chunks behind a protocol: any model can be given; the default works by rules, offline."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ontology import Ontology


class Model(Protocol):
    def complete(self, prompt: str, text: str, max_tokens: int) -> str: ...


def classifier_prompt(onto: Ontology) -> str:
    return f"Does this passage describe any of: {', '.join(sorted({e.root for e in onto.entities}))}? Reply ENTITIES if so, else SKIP."


def extractor_prompt(onto: Ontology) -> str:
    shape = {e.key: ["name", *(f.name for f in e.fields), *([f"{e.selector}: {'|'.join(e.subtypes)}"] if e.selector else [])] for e in onto.entities}
    return "Return one JSON object. Its keys and the fields of their objects:\n" + "\n".join(f"- {k}: {', '.join(v)}" for k, v in shape.items())


def overhead(onto: Ontology, context: int, count, hint: int = 200, reply: int = 512) -> int:
    """Tokens that prompts and replies take of a context window."""
    return max(count(classifier_prompt(onto)) + reply, count(extractor_prompt(onto)) + hint + context // 4)


def label_of(reply: Column) -> Column:
    return F.when(F.contains(F.upper(reply), F.lit("ENTITIES")), "ENTITIES").otherwise("SKIP")


def by_rule(chunks: DataFrame, least: int = 2, text_col: str = "text") -> DataFrame:
    """chunks with a label: passages with some capitalised words inside sentences speak of something with a name."""
    names = F.regexp_count(text_col, F.lit(r"(?<=[\p{Ll},] )\p{Lu}\p{Ll}+"))
    return chunks.withColumn("label", F.when(names >= least, "ENTITIES").otherwise("SKIP"))


def fits(chunks: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Chunks of documents that fit, and doc_id, error of documents that have a chunk beyond `most` tokens."""
    bad = chunks.where(F.col("token_count") > most).groupBy("doc_id").agg(F.max("token_count").alias("n"))
    errors = bad.select("doc_id", F.format_string(f"a chunk has %d tokens, {most} fit; raise the context window or split its section", "n").alias("error"))
    return chunks.join(bad.select("doc_id"), "doc_id", "left_anti"), errors


def with_model(chunks: DataFrame, model: Model, onto: Ontology, max_tokens: int, text_col: str = "text", hint: list[str] | None = None) -> DataFrame:
    """doc_id, chunk_idx, label, body, error of each chunk; only those with entities are extracted. Known names are part of the extractor's
    prompt. A call that fails gives its error and no body; the other chunks go on."""
    ask, extract = classifier_prompt(onto), extractor_prompt(onto) + hint_text(hint or [])

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for d, k, t in zip(batch["doc_id"], batch["chunk_idx"], batch["text"], strict=True):
                label = body = error = None
                try:
                    label = "ENTITIES" if "ENTITIES" in model.complete(ask, t, 512).upper() else "SKIP"
                    body = model.complete(extract, t, max_tokens) if label == "ENTITIES" else None
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                rows.append((d, k, label, body, error))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_idx", "label", "body", "error"])

    return chunks.select("doc_id", "chunk_idx", F.col(text_col).alias("text")).mapInPandas(run, "doc_id string, chunk_idx int, label string, body string, error string")


def hint_text(names: list[str]) -> str:
    """What the extractor's prompt says of names that are known already."""
    return f"\nKnown names, to be written the same way: {'; '.join(names)}." if names else ""


def unfenced(reply: Column) -> Column:
    """A reply without a code fence around it, closed or not."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[^\n]*\n?", ""), r"\n?```\s*$", ""))


def parsed(rows: DataFrame, keys: list[str], reply_col: str = "body") -> DataFrame:
    """rows with ok (a JSON object) and, for each key, how many objects its list has (0 if it is no list)."""
    j = rows.withColumn("_j", F.expr(f"try_parse_json(regexp_replace(regexp_replace(trim({reply_col}), '^```[^\\\\n]*\\\\n?', ''), '\\\\n?```\\\\s*$', ''))"))
    is_object = F.coalesce(F.expr("schema_of_variant(_j)").startswith("OBJECT"), F.lit(False))
    counts = {f"n_{k}": F.when(is_object, F.coalesce(F.size(F.expr(f"try_variant_get(_j, '$.{k}', 'array<variant>')")), F.lit(0))).otherwise(0) for k in keys}
    return j.withColumns({"ok": is_object, **counts}).drop("_j")


def known_names(labels: DataFrame, most: int = 20) -> DataFrame:
    """The hint of known entities: the first names in order."""
    return labels.select("label").distinct().orderBy("label").limit(most)
