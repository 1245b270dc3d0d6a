"""Where nodes come from: source files and the scanners over them, judgments, configurations, stored tables."""
