import os
from fastapi import FastAPI
from src.app.routers import users

app = FastAPI()
app.include_router(users.router, prefix="/users")
app.add_middleware(CORSMiddleware)


@app.middleware("http")
async def timing(request, call_next):
    return await call_next(request)


def main():
    start_server(os.environ["PORT"])


def start_server(port):
    helper(port)


def helper(port):
    return start_server(port)
