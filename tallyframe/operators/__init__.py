"""DataFrame -> DataFrame operators; tenant columns stay as grouping keys."""
