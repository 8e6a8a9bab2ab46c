"""Where rows come from: tables, CSV files, JSON."""
