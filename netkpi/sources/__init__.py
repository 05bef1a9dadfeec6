"""Where rows come from: counter catalogue, CSV exports, staged tables."""
