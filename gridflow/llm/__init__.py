"""Operators of a training-data pipeline: cleaning, deduplicating, scoring,
mixing and packing whole corpora. Nothing else in the library imports this
package; its queries are registered by ``gridflow.llm.queries``."""
