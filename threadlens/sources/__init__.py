"""Sources and sinks: table loaders, fixture views, URL lists, report files."""
