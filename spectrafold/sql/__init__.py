"""SQL access: canonical tables and profiles as views, scalar and table functions."""

from spectrafold.sql.access import FUNCTIONS, PROFILES, TABLE_FUNCTIONS, TABLES, SqlAccess

__all__ = ["FUNCTIONS", "PROFILES", "TABLES", "TABLE_FUNCTIONS", "SqlAccess"]
