"""Registered plans: operators applied to the driver tables, and the DuckDB SQL that they are held against."""
