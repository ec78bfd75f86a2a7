"""DataFrame transformations; none of them triggers a job."""
