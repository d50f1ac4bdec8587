"""Column-level building blocks: text, regex dialect, paths, globs, languages, templates."""
