"""YXDB tables in Spark: a data source for both on-disk layouts, a writer for the row-block one, and geometry functions."""

from .functions import shp_to_wkb, wkb_to_shp
from .operators.reading import (
    YxdbRowReader,
    detect_format,
    fields_frame,
    read,
    read_schema,
    read_spatial_info,
    read_yxdb,
    read_yxdb_arrow,
    read_yxdb_batches,
    read_yxdb_columns,
    read_yxdb_fields,
    read_yxdb_geo,
    read_yxdb_geoarrow,
    read_yxdb_ipc,
    read_yxdb_ipc_batches,
    read_yxdb_pandas,
    record_count,
    scan,
    scan_yxdb,
    session,
    spatial_column_names,
)
from .operators.writing import (
    YxdbWriter,
    sink,
    sink_yxdb,
    string_profile,
    write,
    write_yxdb,
    write_yxdb_arrow,
    write_yxdb_batches,
    write_yxdb_geo,
    write_yxdb_ipc,
    write_yxdb_ipc_batches,
    write_yxdb_pandas,
    write_yxdb_with_overrides,
    write_yxdb_with_schema,
)
from .streaming import read_stream, write_stream
from .types import FieldInfo

__version__ = "0.1.0"
register = session
