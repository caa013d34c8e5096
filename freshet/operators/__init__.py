"""Operators on keyed long tables: (site_id, date, value) and their kin."""
