from . import scores, series, tables, text

__all__ = ["scores", "series", "tables", "text"]
