"""Sources: code bases, settings, baselines, effect dictionaries."""
