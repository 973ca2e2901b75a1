"""Sources and sinks: export files, message tables, the summary store, reports, frames."""
