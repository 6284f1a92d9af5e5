from zonestats.streaming.ingest import ingest_facts

__all__ = ["ingest_facts"]
