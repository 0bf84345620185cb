"""Writers of reports, lines and segments."""
