"""Operators for training-data pipelines. Nothing outside this subpackage imports it."""
PLANS: list[str] = [f"shutterloom.llm.plans_{part}" for part in ("text", "vectors", "copies", "scans")]
