"""Flow, feature, inspection, scoring and Layer-2 operators."""
