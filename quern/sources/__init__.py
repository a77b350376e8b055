"""Where rows come from: type mapping, job specs, and tables that a plan can be pushed to."""
