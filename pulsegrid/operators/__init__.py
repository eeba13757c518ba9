"""Query, vector and alert operators over sample frames."""
