"""Bindings of the operators to the given tables, as named queries with SQL to hold them against."""

from inkwell.plans.timeline_queries import board_watch


def all_queries() -> tuple[dict, dict]:
    """(queries, SQL by name)."""
    from inkwell.plans import dump_queries, ranking_queries, stream_queries, text_queries, timeline_queries

    queries, sql = {}, {}
    for module in (timeline_queries, text_queries, ranking_queries, stream_queries, dump_queries):
        queries |= module.QUERIES
        sql |= module.ORACLE
    return queries, sql


__all__ = ["all_queries", "board_watch"]
