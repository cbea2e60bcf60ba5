"""The Spark data source "yxdb"."""

from .yxdb import YxdbDataSource

__all__ = ["YxdbDataSource"]
