"""Sources and sinks: file trees, repository tables, configuration, journals."""
