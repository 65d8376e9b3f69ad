from .decision_run import DecisionRun, decision_run
from .ingest import Ingested, IngestError, ingest

__all__ = ["DecisionRun", "IngestError", "Ingested", "decision_run", "ingest"]
