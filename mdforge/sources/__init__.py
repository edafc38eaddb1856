"""Sources and sinks: captured pages, the Markdown content table (cache), exports."""
