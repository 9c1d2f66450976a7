"""A PySpark engine for activity logs: ordered events, sessions, links, rollups and text."""
