"""Labels, titles, particles, court codes and the like of Korean legal and administrative texts.

What looks like a name but is a common word is in `vocabulary`.
"""

from __future__ import annotations

COMPOUND_SURNAMES = "남궁 황보 선우 제갈 사공 서문 독고 동방 어금 망절 무본".split()
SURNAMES = "김이박최정강조윤장임한오서신권황안송전홍고문양손배백허유남심노하곽성차주우구민류나지엄변방채원천공현함여염추도소석선설마길연위표명기반라왕금옥육인맹제모진탁국어은편용예봉경리"

REGIONS = "서울특별시 부산광역시 대구광역시 인천광역시 광주광역시 대전광역시 울산광역시 세종특별자치시 경기도 강원특별자치도 강원도 충청북도 충청남도 전북특별자치도 전라북도 전라남도 경상북도 경상남도 제주특별자치도 제주도".split()

ACCOUNT_CONTEXT = "계좌 입금 송금 이체 예금주 통장 무통장 환급 납부 지급받을 은행 국민 신한 우리 하나 농협 기업 수협 우체국 새마을 신협 산업 씨티 케이뱅크 카카오뱅크 토스뱅크 저축은행 증권".split()
CASE_CONTEXT = "사건 판결 선고 소송 항소 상고 결정 재판 법원 심리 판시 판례 기록 병합".split()
REGISTRY_CONTEXT = "법인등록번호 법인번호 등기 등록번호".split()

# Court codes by field of law.
COURT_CODES = (
    "가합 가단 가소 나 다 라 마 머 재가합 재가단 재나 재다 재마 고합 고단 고정 고약 고약전 노 도 로 모 초 보 전고 전노 전도 "
    "구합 구단 구 누 두 아 드합 드단 드 르 므 느합 느단 느 허 후 카합 카단 카기 카담 카확 카허 카명 카불 카임 카정 카소 카열 카조 카구 카경 "
    "타경 타기 타채 타인 타배 회합 회단 회확 하합 하단 하확 개회 개확 개기 즈기 즈합 즈단 브 스 우 수 추 버 푸 크"
).split()
SHORT_COURT_CODES = "가합 가단 가소 나 다 라 마 머 고합 고단 고정 고약 노 도 로 모 초 구합 구단 누 두 드합 드단 르 므 허 후 카합 카단 카기 카담 타경 타기 회합 회단".split()
PLATE_SYLLABLES = "가나다라마거너더러머버서어저고노도로모보소오조구누두루무부수우주아바사자배하허호"
# Words of case numbers of other authorities, and address labels.
PROSECUTION_CODES = "형제 전형제 중제 공제 징수".split()
LABOUR_CODES = "부해 부노 부차 부당".split()
APPEAL_BOARDS = "중앙행심 행심".split()
DECISIONS = "의결 심결 재결 결정 명령".split()
ADDRESS_LABELS = "주소 주거 소재지 등록기준지 거소 사업장".split()
LABOUR_REGIONS = "서울 부산 인천 경기 강원 충북 충남 전북 전남 경북 경남 제주 중노위".split()

ORG_ROLES = (
    "담당변호사 담당노무사 소송복대리인 소송수계인 담당판사 담당검사 원고 피고인 피고 신청인 피신청인 청구인 피청구인 고소인 피고소인 고발인 피고발인 "
    "채권자 채무자 상고인 항소인 항고인 소외 참가인 증인 피의자 피해자 가해자 상대방 대리인 소송대리인 법정대리인 의뢰인 대표이사 대표자 대표 이사장 이사 감사 "
    "사장 부사장 회장 부회장 본부장 실장 센터장 팀장 부장 차장 과장 대리 주임 소장 원장 국장 청장 처장 위원장 담당자 담당 위 같은 해당 당해 저희 우리 본 당사 귀사 상기 전기"
).split()
COMPANY_FORMS = ["주식회사", "유한회사", "유한책임회사", "합자회사", "합명회사", "사단법인", "재단법인", r"\(주\)", "㈜"]
FIRM_FORMS = [r"법무법인(?:\(유(?:한)?\))?", "노무법인", "법률사무소", "회계법인", "세무법인", "법무사사무소", "특허법인"]
CORPORATE_TAILS = "공사 공단 신탁 산업 건설 은행 증권 보험 금융 캐피탈 자산 개발 물산 전자 화학 중공업 시스템 테크 주식회사 조합 재단 법인 위원회 협회 연구원 연구소 대학교 대학 병원 센터 공장 본부 지사 지점".split()

LEGAL_PREFIXES = "담당변호사 소송복대리인 소송대리인 변호사 변호인 재판장 수석부장판사 부장판사 대법관 헌법재판관 판사 검사".split()
PARTY_PREFIXES = (
    "원고 피고 소외 증인 참가인 보조참가인 신청인 피신청인 채권자 채무자 상소인 항소인 상고인 대표이사 이사 대표 담당자 작성자 성명 참조 수신 발신 담당 제출자 "
    "법정대리인 감정인 참고인 의뢰인 피고인 원고인 청구인 피청구인 고소인 피고소인 고발인 피고발인 진정인 피진정인 피항소인 피상고인 항고인 피항고인 재항고인 "
    "연대보증인 보증인 물상보증인 매도인 매수인 임대인 임차인 전차인 수취인 발행인 배서인 예금주 위임인 수임인 위탁자 수탁자 신탁자 수익자 양도인 양수인 "
    "유증자 수유자 유언자 상대방 통역인 목격자 피의자 피해자 가해자 피내사자 용의자 국선변호인 임의대리인 대표자 신고인 피신고인 제보자 본인"
).split()
KINSHIP_PREFIXES = (
    "배우자 남편 아내 부친 모친 아버지 어머니 부모 장남 장녀 차남 차녀 삼남 삼녀 아들 딸 자녀 형제 자매 동생 누나 오빠 언니 조카 사촌 손자 손녀 조부 조모 외조부 외조모 친척 "
    "피상속인 상속인 공동상속인 망인 고인 친권자 후견인 피후견인 부양의무자 세대주 동거인"
).split()
LEGAL_TITLES = "변호사 판사 검사 대법관 헌법재판관 법무사 노무사 회계사 세무사 변리사 감정평가사".split()
POSITIONS = "박사 교수 의사 주무관 계장 대표이사 대표 부사장 사장 부회장 회장 이사장 이사 감사 상무 전무 본부장 실장 센터장 팀장 부장 차장 과장 대리 주임 사원 원장 소장 국장 청장 처장 위원장".split()
HONORIFICS = "씨 님 선생님".split()
LABEL_WORDS = list(dict.fromkeys([*LEGAL_PREFIXES, *PARTY_PREFIXES, *KINSHIP_PREFIXES, *LEGAL_TITLES, *POSITIONS, *HONORIFICS]))

# Particles and copulas after a name, longest first.
JOSA = "에게서 으로서 으로써 에게 한테 께서 에서 으로 이다 이라 이며 이고 이란 라는 라고 로서 로써 부터 까지 밖에 조차 마저 처럼 보다 은 는 이 가 을 를 과 와 의 도 만 로 에 께 나 랑 야 씨 님".split()
KINSHIP_JOSA = "에게서 으로서 에게 한테 께서 에서 으로 이며 이고 라는 라고 로서 부터 까지 처럼 보다 은 는 이 가 을 를 과 와 의 도 만 로 에 들".split()
TRAILING_JOSA = "에게서 으로서 에게 에서 으로 은 는 이 가 을 를 과 와 의 도 에 만 로".split()
JOSA_CHARS = "은는이가을를와과의에도만로랑나며고라야께서밖뿐씨님한테보다처럼같이마저조차부터까지"
ABSORBED_JOSA, PLACE_ENDS = "이가은는을를의에로도과와나만랑", "시군구도읍면리동"

# What stands where a label's name should be; words that follow a kinship word instead of a name.
NOT_NAMES = "법무법인 주식회사 유한회사 합자회사 합명회사 관련사항 선임서 아래 변호사 변호인 검사 피고인 대표이사 담당자 성명 예금주 신청인 대표자 증인 참고인 신문 조서 진술 작성 참여 들의 들이 사장 측에서 미상 불명 미기재 없음 해당없음 동일 상동 생략 별지 별첨 공란 미정".split()
NOT_KIN = (
    "명의 성명 이름 본인 당사자 상대 상대방 일방 쌍방 전원 각자 모두 하나 둘 셋 기타 해당 당시 이하 양육 양육비 양육권 친권 면접 교섭 부양 부양료 위자료 재산 지분 상속 상속분 유류분 유산 유증 증여 협의 "
    "합의 동의 사망 생존 관계 포함 제외 명단 주소 직업 생년 생일 나이 연령 성별 국적 거주 동거 별거 이혼 혼인 재혼 출생 입양 인지 청구 신청 소송 심판 조정"
).split()

def any_of(words: list[str]) -> str:
    """An alternation, longest first."""
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


def hint(words: list[str]) -> str:
    """A cheap pattern that any of the words (of letters) fits: one of their first letters, and if all have more, one of their second ones; blanks may part them."""
    letters = lambda k: "".join(dict.fromkeys(w[k] for w in words))
    return f"[{letters(0)}]" + (f"\\s*[{letters(1)}]" if min(map(len, words)) > 1 else "")
