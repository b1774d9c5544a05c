from tally.sources.files import (  # noqa: F401
    TABLES,
    export_table,
    read_back,
    read_csv,
    read_table,
    sample_table,
)
from tally.sources.xlsx import read_xlsx, write_xlsx  # noqa: F401,E402
