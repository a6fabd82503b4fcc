"""The registered queries by family."""

from importlib import import_module

FAMILIES = ("cell_queries", "block_queries", "rollup_queries", "audit_queries", "template_queries", "check_queries", "source_queries", "stream_queries")


def load() -> None:
    for name in FAMILIES:
        import_module(f"docvigil.plans.{name}")
