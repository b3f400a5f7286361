"""The library's operators as named queries over the driver's tables, with SQL that gives the same rows."""
