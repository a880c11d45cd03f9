"""Plans over the driver's tables, one per operator."""
