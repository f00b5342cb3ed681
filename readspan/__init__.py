"""A PySpark engine for reading-activity data: sessions, calendars, ranked evidence and merges."""
