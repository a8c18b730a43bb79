"""Operators over DataFrames: profiles, overlap groups, layout."""
