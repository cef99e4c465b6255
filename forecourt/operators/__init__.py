"""Lazy DataFrame operators: ``f(df, *, parameters) -> DataFrame``."""
